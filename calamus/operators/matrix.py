"""Distance tables and what is read off them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.functions.numeric import ratio
from calamus.operators.pairing import crossed
from calamus.session import broadcast_if_small, materialize


def distance_table(dists: DataFrame, docs: DataFrame) -> DataFrame:
    """(id_i, id_j, d): the long form, documents named author_title."""
    name = docs.select("doc_id", F.concat_ws("_", "author", "title").alias("id"))
    i, j = name.select(F.col("doc_id").alias("i"), F.col("id").alias("id_i")), name.select(F.col("doc_id").alias("j"), F.col("id").alias("id_j"))
    return dists.join(i, "i").join(j, "j").select("id_i", "id_j", "d")


def dense(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per document and one column per named document, 0 where no distance was computed."""
    return table.groupBy("id_i").pivot("id_j", columns).agg(F.first("d")).na.fill(0.0)


def long(matrix: DataFrame, id_col: str = "id_i") -> DataFrame:
    """A dense table back to rows (id_i, id_j, d)."""
    values = [c for c in matrix.columns if c != id_col]
    return matrix.unpivot(id_col, values, "id_j", "d")


def filled(dists: DataFrame, docs: DataFrame) -> DataFrame:
    """(i, j, d): the table as a dense one holds it: every document j under every column i of `dists` (i, j, d), 0 where no
    distance was computed, so on the diagonal too."""
    every = crossed(dists.select("i").distinct(), docs.select(F.col("doc_id").alias("j")), "i", "j")
    return every.join(dists.select("i", "j", "d"), ["i", "j"], "left").select("i", "j", F.coalesce("d", F.lit(0.0)).alias("d"))


def correlations(dists: DataFrame, n_docs: int, block: int = 256, rows: int = 4_000) -> DataFrame:
    """(a, b, r): Pearson correlation of the columns of a distance table (i the column, j the row) with `n_docs` rows, distances
    in whole thousandths and 0 where there are none; NULL for a column without deviation.

    Sums of products are matrix products: columns are cut into blocks of about `block`, rows into parts of about `rows`; a task
    holds two blocks of one part."""
    t = dists.select("i", "j", (F.col("d") * 1000).cast("int").cast("double").alias("x"))
    t = materialize(t, "columns")
    n_cols = t.select("i").distinct().count()
    blocks, parts = 1 + n_cols // block, 1 + n_docs // rows
    own = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = t.withColumn("own", own).withColumn("part", F.pmod(F.xxhash64("j"), F.lit(parts)).cast("int")).withColumn("other", other)
    tiles = tiles.select("i", "j", "x", "own", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    products = tiles.groupBy("part", "lo", "hi").applyInPandas(_products, "a bigint, b bigint, xy double").groupBy("a", "b").agg(F.sum("xy").alias("xy"))
    one = t.groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n = F.lit(float(n_docs))
    side = lambda c: broadcast_if_small(one.select(F.col("i").alias(c), F.col("s").alias(f"s_{c}"), (n * F.col("q") - F.col("s") * F.col("s")).alias(f"v_{c}")))
    return products.join(side("a"), "a").join(side("b"), "b").select("a", "b", ratio(n * F.col("xy") - F.col("s_a") * F.col("s_b"), F.sqrt(F.col("v_a")) * F.sqrt(F.col("v_b"))).alias("r"))


def _products(f: pd.DataFrame) -> pd.DataFrame:
    """Sums of products over a part's rows between the columns of two blocks, both ways; of one with itself once."""
    lo, hi = f["lo"].iloc[0], f["hi"].iloc[0]
    js, row = np.unique(f["j"].to_numpy(), return_inverse=True)

    def dense_block(own: int) -> tuple[np.ndarray, np.ndarray]:
        mine = (f["own"] == own).to_numpy()
        ids, column = np.unique(f["i"].to_numpy()[mine], return_inverse=True)
        out = np.zeros((len(js), len(ids)))
        out[row[mine], column] = f["x"].to_numpy()[mine]
        return ids, out

    a, x = dense_block(lo)
    b, y = dense_block(hi)
    xy = x.T @ y
    found = pd.DataFrame({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "xy": xy.ravel()})
    return found if lo == hi else pd.concat([found, found.rename(columns={"a": "b", "b": "a"})[["a", "b", "xy"]]])


def closest_other_authors(dists: DataFrame, n: int = 250) -> DataFrame:
    """The n closest pairs by different authors with a distance above 0: (author_i, author_j, i, j, d)."""
    other = dists.where("author_i <> author_j and d > 0").select("author_i", "author_j", "i", "j", "d")
    return other.orderBy(F.round("d", 9), "i", "j").limit(n)


def thousandths(dists: DataFrame) -> DataFrame:
    return dists.withColumn("d", (F.col("d") * 1000).cast("int"))


def complete_linkage(rows: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Complete-linkage merges (a, b, distance, size) of the rows of a small dense table taken as observations; new clusters
    are numbered on from the number of rows. On the driver: for tables that are looked at, up to a few thousand rows."""
    n = len(rows)
    d = np.sqrt(np.maximum(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(-1), 0.0))
    np.fill_diagonal(d, np.inf)
    number, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        a, b = divmod(int(d.argmin()), n)
        a, b = min(a, b), max(a, b)
        size[a] += size[b]
        out.append((min(number[a], number[b]), max(number[a], number[b]), float(d[a, b]), size[a]))
        number[a] = n + step
        far = np.maximum(d[a], d[b])
        d[a], d[:, a] = far, far
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
    return out
