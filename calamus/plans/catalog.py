"""The queries over the reference operators, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calamus.functions import text as T
from calamus.functions.arrays import elements
from calamus.functions.numeric import log_sum_exp, percent
from calamus.operators import counting, entropy, evaluating, impostors, matrix, pairing, scoring, search, smoothing, splitting, weighting
from calamus.operators import distances as dist
from calamus.plans.protocol import Config, SameAuthor
from calamus.session import broadcast_if_small, materialize
from calamus.sources import corpus as source
from calamus.sources import names

Query = Callable[[SparkSession, str], DataFrame]
FEATURES, PAIRS, SEED, EVERY = 1000, 500, 1066, 100
ASKED = f"doc_id % {EVERY} = 0"
VIEW = Config(n_features=FEATURES, n_dev_pairs=PAIRS, n_test_pairs=PAIRS, balanced_pairs=True, metric="minmax", model="tf", seed=SEED)
BOOT = impostors.Bootstrap(n_features=FEATURES, filter_authors=True, seed=SEED)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return source.records(table(spark, sf, "corpus"))


def asked(d: DataFrame) -> DataFrame:
    """The query set of searches: every document whose id is divisible by 100."""
    return d.where(F.col("doc_id") % EVERY == 0)


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").where("text is not null").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_types"))


def deaccent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.deaccent(F.col("text"))).alias("folded"))


def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return elements(docs(spark, sf), [], T.char_ngrams(F.col("words"), 4), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def distinct_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    each = elements(docs(spark, sf), [], "words", "w").distinct()
    grams = F.flatten(F.array(*[_tagged(n) for n in (2, 3, 4, 5)]))
    return elements(each, [], grams, "g").select(F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).distinct().groupBy("n").agg(F.count(F.lit(1)).alias("grams"))


def _tagged(n: int):
    return F.transform(T.char_ngrams(F.array("w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_works").where("text is not null").select("work_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned")).distinct()


def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "raw_works").select("work_id", "file_name", "text").dropDuplicates(["work_id"])
    return source.chunk_files(works).select("name", "n", F.md5("text").alias("chunk"))


def token_halves(spark: SparkSession, sf: str) -> DataFrame:
    """Array functions over token lists: cut, join, halves."""
    d = docs(spark, sf)
    half = F.floor(F.size("words") / 2).cast("int")
    return d.select(
        "doc_id", T.title_stem(F.col("title")).alias("stem"), F.concat_ws("_", "author", "title").alias("label"), F.array_join(F.slice("words", 1, 5), " ").alias("first_words"),
        F.md5(F.array_join(F.slice("words", F.lit(1), half), " ")).alias("first_half"), F.md5(F.array_join(F.slice("words", half + 1, F.size("words")), " ")).alias("second_half"),
    )


def scribe_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return names.seven_fields(table(spark, sf, "soldier_letters").where("file_name is not null").select("file_name").distinct())


def sailing_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return names.dash_fields(table(spark, sf, "soldier_sailing").where("file_name is not null").select("file_name").distinct())


def index_names(spark: SparkSession, sf: str) -> DataFrame:
    return names.index_names(table(spark, sf, "soldier_letters").where("file_name is not null"))


def work_authors(spark: SparkSession, sf: str) -> DataFrame:
    """File names of works read as author and title; those without an author numbered."""
    files = table(spark, sf, "raw_works").where("file_name is not null").select("work_id", "file_name").distinct()
    named = files.select("work_id", "file_name", source.author_of(F.col("file_name")).alias("author"), source.title_of(F.col("file_name")).alias("title"))
    return source.number_unknown(named, "file_name").select("work_id", "author", "title")


def split(which: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: which(docs(spark, sf)).select("doc_id", "phase")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return counting.corpus_stats(splitting.split_authors(docs(spark, sf)))


def author_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counting.author_counts(docs(spark, sf))


def jumbled_halves(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.jumbled_halves(docs(spark, sf)).select("code", "title", F.md5(F.array_join("words", " ")).alias("words"))


def vocab(binary: bool) -> Query:
    return lambda spark, sf: counting.vocabulary(counting.term_counts(docs(spark, sf)), FEATURES, 2, binary)


def vectors(d: DataFrame, model: str, n: int = FEATURES) -> DataFrame:
    counts = materialize(counting.term_counts(d), "counts")
    return weighting.weigh(counts, model, n, d.count())


def vsm(model: str) -> Query:
    return lambda spark, sf: vectors(docs(spark, sf), model).select("doc_id", "term", F.round("value", 6).alias("value"))


def chars(model: str) -> Query:
    """The same models over character n-grams."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = materialize(docs(spark, sf), "docs")
        counts = materialize(counting.ngram_counts(d), "grams")
        return weighting.weigh(counts, model, FEATURES, d.count()).select("doc_id", "term", F.round("value", 6).alias("value"))

    return run


def repeated_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose author has more than one: the labels a map of documents shows."""
    d = docs(spark, sf).select("doc_id", "author")
    many = counting.author_counts(d).where("docs > 1")
    return d.join(broadcast_if_small(many), "author").select("doc_id", "author", "docs")


def dense_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = materialize(counting.term_counts(docs(spark, sf)), "counts")
    v = materialize(counting.vocabulary(counts, None, 1), "vocabulary")
    return materialize(weighting.plm(weighting.restrict(counts, v, whole=True), v, 0.1, 50, None, dense=True), "dense"), weighting.background(v, 0.1)


def plm_dense(spark: SparkSession, sf: str) -> DataFrame:
    return dense_model(spark, sf)[0].select("doc_id", "term", F.round("value", 6).alias("value"))


def plm_topk(spark: SparkSession, sf: str) -> DataFrame:
    return weighting.top_terms(dense_model(spark, sf)[0], 10).select("doc_id", "term", F.round("value", 6).alias("value"), "rank")


def plm_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    lists = term_lists(spark, sf)
    found = entropy.ranked(lists, counting.vocabulary(search.counts(lists), None, 1), ASKED)
    return found.select("q", "doc_id", F.round("ce", 6).alias("ce"), "rank")


def all_pairs(d: DataFrame, control: bool) -> DataFrame:
    return pairing.against_all(asked(d), d, control)


def pairs(control: bool) -> Query:
    return lambda spark, sf: all_pairs(docs(spark, sf), control).select("i", "j", "label")


def pairs_limited(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.limited(all_pairs(docs(spark, sf), True), PAIRS, SEED).select("i", "j", "label")


def pairs_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.balanced(docs(spark, sf), PAIRS, True, SEED).select("i", "j", "label")


def pairs_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.drawn(docs(spark, sf), PAIRS, True, SEED).select("i", "j", "label")


def pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = author_counts(spark, sf).agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * (F.col("docs") - 1)).alias("same"))
    return c.select("n", F.col("same").alias("sadps"), (F.col("n") * (F.col("n") - 1) - F.col("same")).alias("dadps"), percent(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("same_percent"))


def term_lists(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(search.term_lists(source.lean_records(table(spark, sf, "corpus"))), "lists")


def by_blocks(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """All documents with their terms, and the vocabulary, of at most `FEATURES` terms."""
    lists = term_lists(spark, sf)
    return lists, [r["term"] for r in counting.vocabulary(search.counts(lists), FEATURES, 2).collect()]


def block_distance(metric: str, queries: str | None = ASKED) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = search.searched(*by_blocks(spark, sf), queries, metric, search.pairs(6), search.PAIRS)
        return found.select("i", "j", F.when(F.col("same"), pairing.SAME).otherwise(pairing.DIFF).alias("label"), F.col("d").alias("dist"))

    return run


def sample(spark: SparkSession, sf: str, **options) -> SameAuthor:
    d = materialize(splitting.split_authors(docs(spark, sf)), "docs")
    return SameAuthor(replace(VIEW, **options)).vectorize(d)


def fitted(spark: SparkSession, sf: str, **options) -> DataFrame:
    return materialize(sample(spark, sf, **options).fit().withColumn("score", F.round("score", 9)), "scores")


def scores_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf).select("i", "j", "label", F.round("score", 6).alias("score"))


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(sample(spark, sf, model="std").predict().withColumn("score", F.round("score", 9)), "scores")


def scores_joint_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return predicted(spark, sf).select("phase", "i", "j", "label", F.round("score", 6).alias("score"))


def boot_input(spark: SparkSession, sf: str) -> tuple[SameAuthor, DataFrame]:
    v = sample(spark, sf, n_features=BOOT.n_features)
    return v, materialize(v.pairs("dev"), "pairs")


def impostor_topk(spark: SparkSession, sf: str) -> DataFrame:
    v, p = boot_input(spark, sf)
    return impostors.potential(p, v.phase("test"), v.dtm, "minmax", BOOT).select("i", "j", "b", F.round("dist", 6).alias("dist"), F.col("r").cast("int").alias("r"))


def impostor_sigma(top_rank: int, metric: str = "minmax", background: str = "test", **sampling: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v, p = boot_input(spark, sf)
        s = impostors.sigmas(p, v.phase(background), v.dtm, v.terms(), metric, replace(BOOT, top_rank=top_rank, **sampling))
        return s.select("i", "j", "label", F.round("score", 6).alias("score"))

    return run


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def evaluated(how: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(how(fitted(spark, sf)))


def threshold_transfer(spark: SparkSession, sf: str) -> DataFrame:
    p = predicted(spark, sf)
    return rounded(evaluating.transfer(p.where("phase = 'dev'"), p.where("phase = 'test'")))


def nearby(spark: SparkSession, sf: str, body: Callable, schema: str) -> DataFrame:
    return search.searched(*by_blocks(spark, sf), ASKED, "minmax", body, schema)


def distance_table(spark: SparkSession, sf: str) -> DataFrame:
    return nearby(spark, sf, search.labelled(6), search.LABELLED)


def distance_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a dense one holds it: every document in the column of every document of the query set, 0 where no distance was computed."""
    return nearby(spark, sf, search.filled(6), search.FILLED)


def distance_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search.correlations(*by_blocks(spark, sf), ASKED, "minmax"))


def closest_cross_author(spark: SparkSession, sf: str) -> DataFrame:
    s = nearby(spark, sf, search.closest(250), search.CLOSEST)
    return matrix.thousandths(matrix.closest_other_authors(s, 250)).select("author_i", "author_j", "i", "j", "d")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Letters per sailing year, in the order of years."""
    years = table(spark, sf, "soldier_sailing").where("sail_year is not null").groupBy("sail_year").agg(F.count_distinct("sailing_id").alias("n"))
    return years.select((F.row_number().over(Window.orderBy("sail_year")) - 1).cast("bigint").alias("pos"), F.col("n").cast("double").alias("x"))


def smoothed(length: int, window: str) -> Query:
    return lambda spark, sf: rounded(smoothing.smooth(signal(spark, sf), length, window))


def logsum(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "style_vectors").where("vec is not null and size(vec) > 0").select("vec_id", F.transform("vec", lambda x: x.cast("double")).alias("v")).dropDuplicates(["vec_id"])
    return v.select("vec_id", F.round(log_sum_exp(F.col("v")), 6).alias("logsum"))


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Max F1 of each vector space model and metric over the same pairs; counts and pairs are made once."""
    d = materialize(splitting.split_authors(docs(spark, sf)), "docs")
    dev = materialize(pairing.balanced(d.where("phase = 'dev'"), PAIRS, True, SEED), "pairs")
    counts, n = materialize(counting.term_counts(d), "counts"), d.count()
    metrics = tuple(dist.METRICS)
    out = None
    for model in weighting.MODELS:
        found = materialize(dist.of_pairs(dev, weighting.weigh(counts, model, FEATURES, n), *metrics), "distances")
        for m in metrics:
            s = scoring.scaled(found.select("i", "j", "label", F.round(m, 9).alias("dist"))).withColumn("score", F.round("score", 9))
            best = evaluating.best_point(s).select(F.lit(model).alias("vsm"), F.lit(m).alias("metric"), F.round("f1", 6).alias("f1"))
            out = best if out is None else out.unionByName(best)
    return out.groupBy("vsm").pivot("metric", list(metrics)).agg(F.first("f1"))


def queries() -> dict[str, Query]:
    e = evaluating
    return {
        "tokenize_counts": tokenize_counts, "deaccent": deaccent, "char_ngrams": char_ngrams, "distinct_ngrams": distinct_ngrams, "clean_text": clean_text,
        "chunk_words": chunk_words, "token_halves": token_halves, "scribe_metadata": scribe_metadata, "sailing_metadata": sailing_metadata, "index_names": index_names,
        "work_authors": work_authors, "split_authors": split(splitting.split_authors), "split_titles": split(splitting.split_titles), "split_random": split(splitting.split_random),
        "corpus_stats": corpus_stats, "author_counts": author_counts, "jumbled_halves": jumbled_halves, "vocab_topk": vocab(False), "vocab_topk_bin": vocab(True),
        **{f"vsm_{m}": vsm(m) for m in weighting.MODELS}, **{f"vsm_chars_{m}": chars(m) for m in weighting.MODELS}, "repeated_labels": repeated_labels,
        "plm_dense": plm_dense, "plm_topk": plm_topk, "plm_cross_entropy": plm_cross_entropy,
        "pairs_all": pairs(False), "pairs_controlled": pairs(True), "pairs_limited": pairs_limited, "pairs_balanced": pairs_balanced, "pairs_drawn": pairs_drawn, "pair_stats": pair_stats,
        **{f"dist_{m}": block_distance(m) for m in dist.METRICS if m != "divergence"}, "dist_divergence": block_distance("divergence", None), "scores_scaled": scores_scaled, "scores_joint_scaled": scores_joint_scaled,
        "impostor_topk": impostor_topk, "impostor_sigma_top1": impostor_sigma(1), "impostor_sigma_mrr": impostor_sigma(10),
        "impostor_sigma_cityblock": impostor_sigma(1, "cityblock"), "impostor_sigma_authors": impostor_sigma(1, sample_features=False), "impostor_sigma_features": impostor_sigma(1, sample_authors=False),
        "impostor_sigma_plain": impostor_sigma(10, sample_features=False, sample_authors=False), "impostor_sigma_self": impostor_sigma(1, background="dev"), "pr_curve": evaluated(e.pr_curve), "threshold_eval": evaluated(lambda s: e.at_threshold(s, 0.5)),
        "average_precision": evaluated(e.average_precision), "average_precision_step": evaluated(lambda s: e.average_precision(s, "step")),
        "rank_proportional": evaluated(lambda s: e.rank_predict(s, "proportional", 100)), "rank_calibrated": evaluated(lambda s: e.rank_predict(s, "calibrated")),
        "rank_breakeven": evaluated(lambda s: e.rank_predict(s, "break-even-point")), "threshold_transfer": threshold_transfer, "ks_two_sample": evaluated(e.two_sample_ks),
        "kde_grid": evaluated(e.kde), "distance_table": distance_table, "distance_dense": distance_dense, "distance_corr": distance_corr, "closest_cross_author": closest_cross_author,
        "smooth_hanning": smoothed(5, "hanning"), "smooth_flat": smoothed(4, "flat"), "smooth_hamming": smoothed(7, "hamming"), "smooth_bartlett": smoothed(6, "bartlett"),
        "smooth_blackman": smoothed(5, "blackman"), "logsum": logsum, "sweep_vsm_metric": sweep,
    }
