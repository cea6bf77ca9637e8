"""Distances of a query set to all documents, by blocks of documents.

Terms are counted inside a document's row. Documents are packed into blocks of sparse vectors, blocks of queries meet
blocks of documents, and a task turns two blocks into a dense matrix of distances: no pair and no shared term is ever
shuffled, sorted or written but as a row of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.functions.numeric import ratio
from calamus.session import broadcast_if_small, materialize

#: Documents in a block; blocks of queries that may be broadcast; documents that blocks have at least where they are cut smaller.
BLOCK, FEW, LEAST = 1024, 16, 128
#: Of two blocks the one that is met by the other: the parity of their numbers' sum tells, so that each is met by about half the others.
ONCE = "no = q_no or (no < q_no) = ((no + q_no) % 2 = 0)"
LISTS = "doc_id bigint, author string, title string, terms array<string>, tfs array<bigint>"
BLOCKS = "no bigint, ids array<bigint>, authors array<string>, titles array<string>, ends binary, terms binary, vals binary"
PAIRS = "i bigint, j bigint, same boolean, d double"
LABELLED, FILLED = "id_i string, id_j string, d double", "i bigint, j bigint, d double"
CLOSEST = "author_i string, author_j string, i bigint, j bigint, d double"
TILES = "lo bigint, hi bigint, at bigint, i binary, j binary, xy binary, si binary, sj binary"
Met = Iterator[tuple["Block", "Block", np.ndarray]]


def term_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, author, title, terms, tfs): the different terms of each document and how often each occurs."""
    return docs.select("doc_id", "author", "title", "words").mapInArrow(_count, LISTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, n = b.column("words"), b.num_rows
        flat = words.flatten().dictionary_encode()
        known = np.ones(len(flat), bool) if flat.null_count == 0 else flat.is_valid().to_numpy(zero_copy_only=False)
        code = flat.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(1, len(flat.dictionary))
        keys, tf = np.unique((pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64) * size + code)[known], return_counts=True)
        ends = pa.array(np.searchsorted(keys, np.arange(n + 1) * size), pa.int32())
        terms = flat.dictionary.take(pa.array(keys % size)).cast(pa.string())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (terms, pa.array(tf, pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("author"), b.column("title"), *lists], ["doc_id", "author", "title", "terms", "tfs"])


def counts(lists: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of term lists."""
    return lists.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


@dataclass
class Block:
    """Documents' unit-length vectors one after the other: document k has terms[ends[k] : ends[k + 1]] and vals likewise."""

    no: int
    ids: np.ndarray
    authors: list[str]
    titles: list[str]
    ends: np.ndarray
    terms: np.ndarray
    vals: np.ndarray

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum, sum of squares and number of each document's values."""
        own = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
        total = lambda v: np.bincount(own, v, len(self.ids))
        return total(self.vals), total(self.vals * self.vals), np.diff(self.ends).astype(float)

    def dense(self, n_terms: int) -> np.ndarray:
        """A row per term, a column per document."""
        out = np.zeros((n_terms, len(self.ids)))
        out[self.terms, np.repeat(np.arange(len(self.ids)), np.diff(self.ends))] = self.vals
        return out


def packed(lists: DataFrame, vocabulary: list[str], block: int = BLOCK) -> DataFrame:
    """Blocks of at most `block` documents, a batch cut evenly, with their unit-length frequencies of the vocabulary's terms,
    which number at most as many as the model has features."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for whole in batches:
            step = -(-whole.num_rows // max(1, -(-whole.num_rows // block))) or 1
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                n = b.num_rows
                term = pc.index_in(b.column("terms").flatten(), value_set=known)
                held = term.is_valid().to_numpy(zero_copy_only=False)
                own = pc.list_parent_indices(b.column("terms")).to_numpy(zero_copy_only=False)[held]
                tf = b.column("tfs").flatten().to_numpy(zero_copy_only=False)[held].astype(float)
                vals = tf / np.sqrt(np.bincount(own, tf * tf, n))[own]
                ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64)
                terms = term.drop_null().to_numpy(zero_copy_only=False).astype(np.int32)
                ids = b.column("doc_id").to_pylist()
                row = {"no": hash(tuple(ids)) % (1 << 62), "ids": ids, "authors": b.column("author").to_pylist(), "titles": b.column("title").to_pylist()}
                yield pa.RecordBatch.from_pylist([row | {"ends": ends.tobytes(), "terms": terms.tobytes(), "vals": vals.tobytes()}], _schema(BLOCKS))

    return materialize(lists.where("doc_id is not null").mapInArrow(pack, BLOCKS), "blocks")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def meet(queries: DataFrame, docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every block of `docs` with every row of blocks of `queries`: few of these are broadcast, many are read again by each task."""
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    n = docs.count()
    tasks = tasks or max(8 * parallel, n // 16)
    queries = F.broadcast(queries) if queries.count() <= FEW else queries
    return docs.repartition(max(1, min(n, tasks)), "no").crossJoin(queries)


def meet_once(blocks: DataFrame) -> DataFrame:
    """Every block with itself and with each other block, either as `q` or as `d`."""
    return meet(side(blocks, "q"), side(blocks, "d").withColumnRenamed("d_no", "no")).where(ONCE)


def side(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{name}_{c}") for c in blocks.columns])


def read_block(b: pa.RecordBatch, k: int, name: str) -> Block:
    at = {c: b.column(f"{name}_{c}")[k] for c in ("no", "ids", "authors", "titles", "ends", "terms", "vals")}
    raw = [np.frombuffer(at[c].as_py(), t) for c, t in (("ends", np.int64), ("terms", np.int32), ("vals", np.float64))]
    return Block(at["no"].as_py(), at["ids"].values.to_numpy(zero_copy_only=False), at["authors"].as_py(), at["titles"].as_py(), *raw)


def nearest(x: np.ndarray, digits: int) -> np.ndarray:
    """Values of 0 or more rounded, halves up."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _least(a, b):
    return np.minimum(a, b, out=a).sum(0)


def _dot(a, b):
    return (b.T @ a)[0]


def _alike(a, b):
    """A quarter for each shared term of equal values, less the more they differ."""
    s = a + b
    np.multiply(s, s, out=s)
    return (b.T @ np.divide(a, s, out=s))[0]


def _minmax(x, q, d):
    most = q[0] + d[0][:, None] - x
    return np.maximum(0.0, np.divide(most - x, most, out=np.zeros_like(x), where=most > 0))


def _euclidean(x, q, d):
    return np.sqrt(np.maximum(0.0, nearest(q[1] + d[1][:, None] - 2 * x, 12)))


def _cityblock(x, q, d):
    return np.maximum(0.0, q[0] + d[0][:, None] - 2 * x)


def _cosine(x, q, d):
    norms = np.sqrt(q[1] * d[1][:, None])
    return np.maximum(0.0, 1 - np.divide(x, norms, out=np.full_like(x, np.nan), where=norms > 0))


def _divergence(x, q, d, shared):
    """A term that one document lacks counts 4, a shared one 4 less 16 times its part of x."""
    return np.maximum(0.0, 4 * (q[2] + d[2][:, None] - shared) - 16 * x)


#: Per metric: what a document's terms add up to against the columns of a dense block, and the distance from that and both sides' sums (NaN for none).
METRICS: dict[str, tuple[Callable, Callable]] = {"minmax": (_least, _minmax), "euclidean": (_dot, _euclidean), "cityblock": (_least, _cityblock), "cosine": (_dot, _cosine), "divergence": (_alike, _divergence)}


def matrix(q: Block, d: Block, metric: str, n_terms: int, dense: np.ndarray) -> np.ndarray:
    """A row per document of `d`, a column per one of `q`, whose dense form is given."""
    over, distance = METRICS[metric]
    x = np.zeros((len(d.ids), len(q.ids)))
    for k, (lo, hi) in enumerate(zip(d.ends[:-1], d.ends[1:], strict=True)):
        if hi > lo:
            x[k] = over(dense[d.terms[lo:hi]], d.vals[lo:hi, None])
    if metric != "divergence":
        return distance(x, q.sums(), d.sums())
    return distance(x, q.sums(), d.sums(), (d.dense(n_terms) > 0).astype(np.float32).T @ (dense > 0).astype(np.float32))


def searched(lists: DataFrame, vocabulary: list[str], queries: str | None, metric: str, body: Callable[[Met], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `body` makes of the distances of the documents that `queries` selects (all without it) to all documents. It gets
    blocks of queries, of documents and their matrices, one after the other. Without `queries` two blocks meet once, and the
    matrix serves both ways; of few documents blocks are smaller, so that all cores have some."""
    if queries is None:
        cut = lists.count() // (3 * lists.sparkSession.sparkContext.defaultParallelism) + 1
        met_blocks = meet_once(packed(lists, vocabulary, min(BLOCK, max(LEAST, cut))))
    else:
        docs = packed(lists, vocabulary)
        few = lists.where(queries)
        asking = packed(few.repartition(1 + few.count() // BLOCK), vocabulary)
        met_blocks = meet(side(asking, "q"), side(docs, "d").withColumnRenamed("d_no", "no"))
    n_terms = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met() -> Met:
            kept: dict[int, np.ndarray] = {}
            for b in batches:
                for k in range(b.num_rows):
                    q, d = read_block(b, k, "q"), read_block(b, k, "d")
                    if q.no not in kept:
                        if len(kept) >= 4:
                            kept.pop(next(iter(kept)))
                        kept[q.no] = q.dense(n_terms)
                    yield q, d, (x := matrix(q, d, metric, n_terms, kept[q.no]))
                    if queries is None and q.no != d.no:
                        yield d, q, np.ascontiguousarray(x.T)

        return body(met())

    return met_blocks.withColumnRenamed("no", "d_no").mapInArrow(run, schema)


def _same_author(q: Block, d: Block) -> np.ndarray:
    number = {a: k for k, a in enumerate(dict.fromkeys(q.authors))}
    mine, theirs = np.array([number[a] for a in q.authors]), np.array([number.get(a, -1) for a in d.authors])
    return theirs[:, None] == mine


def _parts(q: Block, d: Block, x: np.ndarray, rows: int = 256) -> Iterator[tuple[slice, np.ndarray]]:
    """A few documents at a time, with the pairs (true) that are of two documents."""
    for at in range(0, len(d.ids), rows):
        part = slice(at, at + rows)
        yield part, d.ids[part, None] != q.ids


def pairs(digits: int) -> Callable[[Met], Iterator[pa.RecordBatch]]:
    """(i, j, same, d): every pair of two documents."""

    def body(met: Met) -> Iterator[pa.RecordBatch]:
        for q, d, x in met:
            same, x = _same_author(q, d), nearest(x, digits)
            for part, two in _parts(q, d, x):
                i, j = np.broadcast_to(q.ids, two.shape), np.broadcast_to(d.ids[part, None], two.shape)
                cols = [v.ravel() if two.all() else v[two] for v in (i, j, same[part], x[part])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), pa.array(cols[3], from_pandas=True)], schema=_schema(PAIRS))

    return body


def labelled(digits: int) -> Callable[[Met], Iterator[pa.RecordBatch]]:
    """(id_i, id_j, d): every pair of two documents, by their names author_title."""

    def names(b: Block) -> pa.Array:
        return pa.array([f"{a}_{t}" for a, t in zip(b.authors, b.titles, strict=True)], pa.string())

    def body(met: Met) -> Iterator[pa.RecordBatch]:
        for q, d, x in met:
            x, mine, theirs = nearest(x, digits), names(q), names(d)
            for part, two in _parts(q, d, x):
                j, i = np.nonzero(two)
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(i)), theirs.take(pa.array(j + part.start)), pa.array(x[part][two])], schema=_schema(LABELLED))

    return body


def filled(digits: int) -> Callable[[Met], Iterator[pa.RecordBatch]]:
    """(i, j, d): every document j under every query i, 0 for a document with itself."""

    def body(met: Met) -> Iterator[pa.RecordBatch]:
        for q, d, x in met:
            x = nearest(x, digits)
            for part, two in _parts(q, d, x):
                i, j = np.broadcast_to(q.ids, two.shape), np.broadcast_to(d.ids[part, None], two.shape)
                yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, np.where(two, x[part], 0.0))], schema=_schema(FILLED))

    return body


def closest(n: int, digits: int = 9) -> Callable[[Met], Iterator[pa.RecordBatch]]:
    """(author_i, author_j, i, j, d): of the pairs by different authors with a distance above 0, each task's `n` closest, ties by
    smaller ids. The n closest of all are among them."""

    def body(met: Met) -> Iterator[pa.RecordBatch]:
        best: list[tuple[float, int, int, str, str]] = []
        for q, d, x in met:
            x = nearest(x, digits)
            fit = ~_same_author(q, d) & (x > 0)
            if len(best) == n:
                fit &= x <= best[-1][0]
            j, i = np.nonzero(fit)
            first = np.lexsort((d.ids[j], q.ids[i], x[j, i]))[:n] if len(j) <= 20 * n else _first(x[j, i], q.ids[i], d.ids[j], n)
            found = [(float(x[j[k], i[k]]), int(q.ids[i[k]]), int(d.ids[j[k]]), q.authors[i[k]], d.authors[j[k]]) for k in first]
            best = sorted(best + found)[:n]
        yield pa.RecordBatch.from_pylist([{"author_i": a, "author_j": b, "i": i, "j": j, "d": x} for x, i, j, a, b in best], _schema(CLOSEST))

    return body


def _first(x: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Where the n smallest are, in order; what ties with the last is compared whole."""
    near = np.nonzero(x <= np.partition(x, n - 1)[n - 1])[0]
    return near[np.lexsort((j[near], i[near], x[near]))[:n]]


def correlations(lists: DataFrame, vocabulary: list[str], queries: str, metric: str, block: int = 4096, rows: int = 64) -> DataFrame:
    """(a, b, r): Pearson correlation of the queries' columns of distances to all documents, in whole thousandths, 0 for a document
    with itself; NULL for a column without deviation. A task adds up products of the columns of two blocks over its
    documents, exactly, and hands on `rows` columns of sums at a time."""
    docs, few = packed(lists, vocabulary), lists.where(queries)
    n_docs, n_terms = float(lists.where("doc_id is not null").count()), len(vocabulary)
    asking = packed(few.repartition(1 + few.count() // block), vocabulary, block)
    two = side(asking, "a").crossJoin(side(asking, "b")).where("a_no <= b_no")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, d = (read_block(batch, k, s) for s in "abd")
                if (key := (a.no, b.no)) not in sums:
                    sums[key] = [a.ids, b.ids, np.zeros((len(a.ids), len(b.ids))), np.zeros(len(a.ids)), np.zeros(len(b.ids)), a.dense(n_terms), b.dense(n_terms) if a.no != b.no else None]
                s = sums[key]
                x = columns(a, d, s[5])
                y = x if s[6] is None else columns(b, d, s[6])
                s[2] += x.T @ y
                s[3] += x.sum(0)
                s[4] += y.sum(0)
        for (lo, hi), (i, j, xy, si, sj, _, _) in sums.items():
            for at in range(0, len(i), rows):
                part = slice(at, at + rows)
                row = {"lo": lo, "hi": hi, "at": at, "i": i[part].tobytes(), "j": j.tobytes(), "xy": xy[part].tobytes(), "si": si[part].tobytes(), "sj": sj.tobytes()}
                yield pa.RecordBatch.from_pylist([row], _schema(TILES))

    def columns(q: Block, d: Block, dense: np.ndarray) -> np.ndarray:
        x = np.trunc(nearest(matrix(q, d, metric, n_terms, dense), 9) * 1000)
        x[d.ids[:, None] == q.ids] = 0.0
        return x

    tiles = meet(two, side(docs, "d").withColumnRenamed("d_no", "no"), 2 * lists.sparkSession.sparkContext.defaultParallelism).withColumnRenamed("no", "d_no").mapInArrow(add, TILES)
    sums = materialize(tiles.groupBy("lo", "hi", "at").applyInPandas(_added, "a bigint, b bigint, xy double, s_a double"), "products")
    one = sums.where("a = b").select("a", "s_a", "xy")
    n = F.lit(n_docs)
    of = lambda c: broadcast_if_small(one.select(F.col("a").alias(c), F.col("s_a").alias(f"s_{c}"), (n * F.col("xy") - F.col("s_a") * F.col("s_a")).alias(f"v_{c}")))
    return sums.drop("s_a").join(of("a"), "a").join(of("b"), "b").select("a", "b", ratio(n * F.col("xy") - F.col("s_a") * F.col("s_b"), F.sqrt(F.col("v_a")) * F.sqrt(F.col("v_b"))).alias("r"))


def _added(f: pd.DataFrame) -> pd.DataFrame:
    """Sums over tasks of the products of some columns with those of a block, both ways unless it is their own."""
    numbers = lambda c: np.frombuffer(f[c].iloc[0], np.int64)
    total = lambda c: sum(np.frombuffer(x) for x in f[c])
    i, j = numbers("i"), numbers("j")
    a, b, xy = np.repeat(i, len(j)), np.tile(j, len(i)), total("xy")
    found = pd.DataFrame({"a": a, "b": b, "xy": xy, "s_a": np.repeat(total("si"), len(j))})
    return found if f["lo"].iloc[0] == f["hi"].iloc[0] else pd.concat([found, pd.DataFrame({"a": b, "b": a, "xy": xy, "s_a": np.tile(total("sj"), len(i))})])
