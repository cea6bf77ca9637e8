"""Development and test halves, and the jumbled-halves dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calamus.functions.hashing import key, positions
from calamus.functions.text import title_stem
from calamus.operators.counting import author_counts


def halves(docs: DataFrame, *by: Column, seed: int = 10) -> DataFrame:
    """Documents with `phase`: the groups named by `by` are put in a hashed order, the first half (rounded down) is `dev`,
    the rest `test`; documents of a group stay together."""
    names = [f"_g{i}" for i in range(len(by))]
    grouped = docs.select("*", *[c.alias(n) for n, c in zip(names, by, strict=True)])
    groups = grouped.select(*names).distinct().withColumn("_key", key(seed, *[F.col(n) for n in names]))
    placed = positions(groups, "_key", "_pos").crossJoin(groups.agg(F.count(F.lit(1)).alias("_all")))
    phase = F.when(F.col("_pos") < F.floor(F.col("_all") / 2), "dev").otherwise("test")
    return grouped.join(placed.select(*names, phase.alias("phase")), names).drop(*names)


def split_authors(docs: DataFrame, seed: int = 10) -> DataFrame:
    return halves(docs, F.col("author"), seed=seed)


def split_titles(docs: DataFrame, seed: int = 10) -> DataFrame:
    return halves(docs, F.col("author"), title_stem(F.col("title")), seed=seed)


def split_random(docs: DataFrame, seed: int = 10) -> DataFrame:
    return halves(docs, F.col("doc_id"), seed=seed)


def jumbled_halves(docs: DataFrame, seed: int = 1000) -> DataFrame:
    """(code, title, words): documents of authors with more than one, their words shuffled and cut in two (the first half
    rounded down); both halves have the document's code as author and title code + a / b. The shuffle sorts by a hash."""
    many = author_counts(docs).where("docs > 1").select("author")
    code = F.col("doc_id").cast("string")
    ordered = F.transform(F.array_sort(F.transform("words", lambda w, p: F.struct(key(seed, F.col("doc_id"), p).alias("k"), p.alias("p"), w.alias("w")))), lambda s: s["w"])
    each = docs.join(many, "author", "left_semi").select(code.alias("code"), ordered.alias("words")).withColumn("half", F.floor(F.size("words") / 2).cast("int"))
    a = each.select("code", F.concat("code", F.lit("a")).alias("title"), F.slice("words", F.lit(1), F.col("half")).alias("words"))
    b = each.select("code", F.concat("code", F.lit("b")).alias("title"), F.slice("words", F.col("half") + 1, F.size("words") - F.col("half")).alias("words"))
    return a.unionByName(b)
