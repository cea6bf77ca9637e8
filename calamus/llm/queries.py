"""The queries of the training-data problems and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calamus.functions.text import token_count
from calamus.llm import distinctive, frequencies, mixing, names, packing, pieces, splits, sql, stuffing, vectors

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.marking_terms(_t(spark, sf, "corpus"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequencies.marked_terms(_t(spark, sf, "corpus")).where("mark is not null").select("term", "mark")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tied_authors(splits.author_components(_t(spark, sf, "corpus")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.close_pairs(_t(spark, sf, "style_vectors"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.needed_cuts(pieces.cut_works(_t(spark, sf, "raw_works")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    stored = names.stored_names(_t(spark, sf, "soldier_letters"), _t(spark, sf, "soldier_sailing"))
    return names.same_person(names.persons(stored, _t(spark, sf, "given_names")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.divided(packing.pack(_t(spark, sf, "documents")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    report = mixing.schedule(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[1]
    return report.where("short").select("mix_name", "source")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.spam_pages(_t(spark, sf, "documents")).select("doc_id")


def p1_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every record with its score."""
    scored = distinctive.log_entropy(_t(spark, sf, "corpus"))
    return scored.select("doc_id", "term", "tf", "cf", "df", F.round("score", 6).alias("score"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct term with its occurrences and records."""
    return frequencies.term_frequencies(_t(spark, sf, "corpus"))


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its label."""
    return splits.split_records(_t(spark, sf, "corpus"))[0]


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar vectors of every usable vector, however similar."""
    return vectors.nearest(_t(spark, sf, "style_vectors"))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every work."""
    return pieces.cut_works(_t(spark, sf, "raw_works"))


def p6_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with the person it refers to."""
    stored = names.stored_names(_t(spark, sf, "soldier_letters"), _t(spark, sf, "soldier_sailing"))
    return names.persons(stored, _t(spark, sf, "given_names"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or piece of one, with its container."""
    return packing.pack(_t(spark, sf, "documents"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(packing.pack(_t(spark, sf, "documents")))


def p8_copies(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is taken in each mix."""
    return mixing.schedule(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached."""
    report = mixing.schedule(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[1]
    return report.select("mix_name", "source", "target_share", "tokens", F.round("share", 6).alias("share"), "short")


def p9_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Spam pages with their words, and those in spam passages."""
    return stuffing.spam_pages(_t(spark, sf, "documents"))


def p3_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, the second with the records loaded after the middle of all only. (doc_id, problem): records without one label
    each, labels of the first run that changed, new records whose component has another label; and members forgotten (id 0)."""
    corpus = _t(spark, sf, "corpus")
    middle = corpus.agg(F.percentile_approx("loaded_at", 0.5).alias("at")).first()["at"]
    late = F.coalesce(F.col("loaded_at") > F.lit(middle), F.lit(False))
    one, before = splits.split_records(corpus.where(~late))
    two, after = splits.split_records(corpus.where(late), before)
    ids = corpus.where("doc_id is not null").select("doc_id").distinct()
    labelled = after.records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lost = ids.join(labelled, "doc_id", "left").where("n is null or n <> 1").select("doc_id", F.lit("not one label").alias("problem"))
    moved = after.records.alias("a").join(one.alias("b"), "doc_id").where("a.split <> b.split").select("doc_id", F.lit("moved").alias("problem"))
    members = after.members.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    new = two.select("doc_id", F.col("split").alias("_got")).join(one.select("doc_id"), "doc_id", "left_anti")
    home = after.records.select("doc_id", "component").join(members, "component")
    torn = new.join(home, "doc_id").where("_got <> 'quarantine' and (lo <> hi or lo <> _got)").select("doc_id", F.lit("torn").alias("problem"))
    gone = before.members.join(after.members, ["kind", "member"], "left_anti").select(F.lit(0).cast("bigint").alias("doc_id"), F.lit("forgotten").alias("problem"))
    return lost.unionByName(moved).unionByName(torn).unionByName(gone)


def p5_broken(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, problem): works whose pieces are too long, don't share 50 words, or leave out or repeat words."""
    x = pieces.cut_works(_t(spark, sf, "raw_works")).drop("text")
    order = Window.partitionBy("work_id").orderBy("piece")
    x = x.withColumn("_new", F.col("n_words") - F.col("overlap")).withColumn("_at", F.sum("_new").over(order) - F.col("_new"))
    x = x.withColumn("_last", F.lead("piece").over(order).isNull())
    wrong = (F.col("n_words") > 1000) | ((F.col("piece") > 1) & (F.col("overlap") != 50)) | (F.col("_at") != F.col("first_word")) | (F.col("_last") & (F.col("_at") + F.col("_new") != F.col("work_words")))
    return x.where(wrong).select(F.col("work_id").alias("doc_id"), F.lit("piece").alias("problem"))


def p7_broken(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, problem): containers too full (their number), texts cut without need, tokens lost."""
    docs, packed = _t(spark, sf, "documents"), packing.pack(_t(spark, sf, "documents"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).where("t > 1024").select(F.col("container").alias("doc_id"), F.lit("too full").alias("problem"))
    each = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    cut = each.where("n > ceil(t / 1024)").select("doc_id", F.lit("cut without need").alias("problem"))
    sized = docs.select("doc_id", F.coalesce(token_count(F.col("text")), F.lit(0)).alias("_n")).where("_n > 0")
    lost = sized.join(each, "doc_id", "left").where("t is null or t <> _n").select("doc_id", F.lit("tokens lost").alias("problem"))
    return full.unionByName(cut).unionByName(lost)


def queries() -> dict[str, Query]:
    found = (p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_found, p8_found, p9_found)
    whole = (p1_scores, p2_counts, p3_splits, p3_broken, p4_neighbours, p5_pieces, p5_broken, p6_persons, p7_containers, p7_fill, p7_broken, p8_copies, p8_report, p9_pages)
    return {f.__name__: f for f in (*found, *whole)}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLE
