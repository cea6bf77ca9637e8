"""Document pairs: a stated query set against all documents, and samples of pairs that never build them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calamus.functions.hashing import cumulative, draw, key, positions
from calamus.functions.text import title_stem
from calamus.session import broadcast_if_small, materialize

SAME, DIFF = "same_author", "diff_author"


def label(a: Column, b: Column) -> Column:
    return F.when(a == b, SAME).otherwise(DIFF)


def both_stems_agree(a: Column, b: Column) -> Column:
    """Both titles hold `_` and agree up to it."""
    return (F.instr(a, "_") > 0) & (F.instr(b, "_") > 0) & (title_stem(a) == title_stem(b))


def crossed(queries: DataFrame, docs: DataFrame, i: str, j: str, block: int = 2000, spread: int = 32) -> DataFrame:
    """Every row of `queries` (id `i`) with every row of `docs` (id `j`).

    Queries are cut into blocks of about `block`; every document meets each block once, in one of `spread` parts, by an
    equality join on (block, part): no side is broadcast or held whole."""
    blocks = 1 + queries.count() // block
    q = queries.withColumn("_block", F.pmod(F.xxhash64(i), F.lit(blocks))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    d = docs.withColumn("_part", F.pmod(F.xxhash64(j), F.lit(spread)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return q.join(d, ["_block", "_part"]).drop("_block", "_part")


def against_all(queries: DataFrame, docs: DataFrame, control: bool = False, block: int = 2000, spread: int = 32) -> DataFrame:
    """(i, j, author_i, author_j, title_i, title_j, label): each query document with every other document. With `control`,
    pairs whose title stems agree are left out."""
    side = lambda df, s: df.select(F.col("doc_id").alias(s), F.col("author").alias(f"author_{s}"), F.col("title").alias(f"title_{s}"))
    pairs = crossed(side(queries, "i"), side(docs, "j"), "i", "j", block, spread).where("i <> j")
    if control:
        pairs = pairs.where(~both_stems_agree(F.col("title_i"), F.col("title_j")))
    return pairs.withColumn("label", label(F.col("author_i"), F.col("author_j")))


def limited(pairs: DataFrame, n: int | None, seed: int = 1066) -> DataFrame:
    """The first n pairs of a hashed order; None for all."""
    return pairs if n is None else pairs.orderBy(key(seed, F.col("i"), F.col("j")), "i", "j").limit(n)


def _index(docs: DataFrame, control: bool, seed: int) -> tuple[DataFrame, int, int, int]:
    """Documents with what numbers their pairs, written once, and how many documents, same-author and other pairs there are:
    `_start` and `_c`, the first position and number of the author's documents; `_rank`, the place among them; `_gs` and `_gn`,
    the first place and number of those that cannot be its partner (itself, and with `control` its title's stem)."""
    group = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    if control:
        group = F.when(F.instr("title", "_") > 0, F.concat(F.lit("s"), title_stem(F.col("title")))).otherwise(group)
    meta = docs.select("doc_id", "author", "title", key(seed, F.col("doc_id")).alias("_key"), group.alias("_g"))
    groups = meta.groupBy("author", "_g").agg(F.count(F.lit(1)).alias("_gn"))
    groups = cumulative(groups.withColumn("_gkey", F.md5("_g")), "_gkey", F.col("_gn"), "_gs", within=("author",)).drop("_gkey")
    authors = meta.groupBy("author").agg(F.count(F.lit(1)).alias("_c")).withColumn("_akey", key(seed, F.col("author")))
    authors = cumulative(authors, "_akey", F.col("_c"), "_start").drop("_akey")
    placed = positions(meta, "_key", "_in", within=("author", "_g")).join(groups, ["author", "_g"]).join(authors, "author")
    rows = materialize(placed.withColumn("_rank", F.col("_gs") + F.col("_in")).drop("_in", "_g"), "pair-index")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("_c") - F.col("_gn")), F.lit(0)).alias("same"), F.coalesce(F.sum("_c"), F.lit(0)).alias("own")).first()
    return rows, n["n"], n["same"], n["n"] * n["n"] - n["own"]


def _drawn(rows: DataFrame, weight: Column, size: int, partner: Callable[[Column], Column], place: list[str], n: int, name: str, control: bool, seed: int, tries: int) -> DataFrame:
    """The first `n` different pairs, or all if they are fewer, of a numbering in which document i has `weight` of `size` numbers,
    `partner` of its q-th the place (columns `place`) of j. Numbers are drawn, `tries` times n of them; pairs whose stems
    agree are rejected (with `control`), and if too few are left, eight times as many are drawn, until all numbers there are are
    taken instead of drawn. A number finds its document by hash bucket, then in the bucket, so the draws alone are small."""
    spark = rows.sparkSession
    spans = cumulative(rows.withColumn("_w", weight), "_key", F.col("_w"), "_from").withColumn("_b", F.substring("_key", 1, 3))
    spans = materialize(spans, "pair-spans")
    ends = spans.groupBy("_b").agg(F.min("_from").alias("_lo"), F.max(F.col("_from") + F.col("_w")).alias("_hi"))  # at most 4096 rows
    side = lambda df, s: df.select(*place, F.col("doc_id").alias(s), F.col("author").alias(f"author_{s}"), F.col("title").alias(f"title_{s}"))
    draws = tries * n
    while True:
        every = size <= draws
        k = spark.range(size if every else draws).withColumnRenamed("id", "k")
        x = F.col("k") if every else draw(F.lit(size), seed, name, F.col("k"))
        o = key(seed, "all", F.col("k")) if every else F.lpad(F.col("k").cast("string"), 15, "0")
        k = k.select(x.alias("_x"), o.alias("_o"))
        found = k.join(F.broadcast(ends), (F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi"))).select("_b", "_x", "_o")
        found = spans.join(broadcast_if_small(found), "_b").where((F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_from") + F.col("_w")))
        found = found.select(F.col("doc_id").alias("i"), F.col("author").alias("author_i"), F.col("title").alias("title_i"), "_o", *[F.col(c) for c in place if c == "author"], partner(F.col("_x") - F.col("_from")).alias(place[-1]))
        pairs = side(rows, "j").join(broadcast_if_small(found), place).select("i", "j", "author_i", "author_j", "title_i", "title_j", "_o")
        if control:
            pairs = pairs.where(~both_stems_agree(F.col("title_i"), F.col("title_j")))
        pairs = materialize(pairs.groupBy("i", "j").agg(F.min(F.struct("_o", "author_i", "author_j", "title_i", "title_j")).alias("s")).select("i", "j", "s.*"), "pairs")
        if every or pairs.count() >= n:
            return pairs.orderBy("_o").limit(n).drop("_o")
        draws *= 8


def drawn(docs: DataFrame, n: int, control: bool = True, seed: int = 1066, tries: int = 4) -> DataFrame:
    """n ordered pairs of all, all if they are fewer: (i, j, author_i, author_j, title_i, title_j, label). None is enumerated but
    where nearly all are wanted."""
    rows, size, _, _ = _index(docs, control, seed)
    rows = rows.withColumn("_pos", F.col("_start") + F.col("_rank"))
    skip = lambda q: q + F.when(q >= F.col("_pos"), 1).otherwise(0)
    pairs = _drawn(rows, F.lit(size - 1), size * (size - 1), skip, ["_pos"], n, "any", control, seed, tries)
    return pairs.withColumn("label", label(F.col("author_i"), F.col("author_j")))


def balanced(docs: DataFrame, n: int, control: bool = True, seed: int = 1066, tries: int = 4) -> DataFrame:
    """n ordered pairs, half by the same author and half by different ones: (i, j, author_i, author_j, title_i, title_j, label).
    Where there are fewer by the same author, all of them; the different-author half is as large as the other.

    Pairs are numbered without being listed: same-author pairs by document and its eligible partners, so that a drawn number
    is an eligible pair; different-author pairs by document and the documents of other authors.
    """
    rows, _, same, diff = _index(docs, control, seed)
    jump = lambda start, many: lambda q: q + F.when(q >= start, many).otherwise(0)
    one = _drawn(rows, F.col("_c") - F.col("_gn"), same, jump(F.col("_gs"), F.col("_gn")), ["author", "_rank"], n // 2, "same", control, seed, tries * 2)
    one = materialize(one, "same-pairs")
    rows = rows.withColumn("_pos", F.col("_start") + F.col("_rank"))
    many = docs.count()
    other = _drawn(rows, F.lit(many) - F.col("_c"), diff, jump(F.col("_start"), F.col("_c")), ["_pos"], one.count(), "diff", control, seed, tries * 2)
    return one.unionByName(other).withColumn("label", label(F.col("author_i"), F.col("author_j")))
