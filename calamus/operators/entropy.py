"""Documents ranked for queries by the cross-entropy of dense language models, by blocks: neither the models' rows nor the pairs are
shuffled or sorted on disk; a task holds the entropies of a few queries with all documents and ranks them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.functions.ordering import numbered
from calamus.operators import search
from calamus.operators.weighting import background, cross_entropy, plm, rank_models, restrict
from calamus.session import materialize, mounted, small_enough

#: Vocabulary terms that may be sent to every worker; bytes of entropies that a task holds; documents in a block.
TERMS, HELD, BLOCK = 2_000_000, 128 << 20, 1024
KNOWN = "doc_id bigint, terms array<bigint>, tfs array<bigint>, pcs array<double>"
MODELS = "no bigint, ids binary, ends binary, terms binary, vals binary, base binary"
RANKED = "q bigint, doc_id bigint, ce double, rank int"


def known(lists: DataFrame, vocab: DataFrame, weight: float) -> tuple[DataFrame, int]:
    """(doc_id, terms, tfs, pcs): documents' term numbers, counts and background shares; and the number of terms there are."""
    v = background(vocab, weight)
    lists = lists.where("doc_id is not null and size(terms) > 0").select("doc_id", "terms", "tfs")
    if not small_enough(v, TERMS):
        v = materialize(numbered(v, "n", "term"), "numbered-terms")
        rows = search.counts(lists).join(v, "term").groupBy("doc_id").agg(F.collect_list(F.struct("n", "tf", "pc")).alias("x"))
        return rows.select("doc_id", F.col("x.n").alias("terms"), F.col("x.tf").alias("tfs"), F.col("x.pc").alias("pcs")), v.count()
    whole = v.select("term", "pc").toArrow().combine_chunks()
    shared = lists.sparkSession.sparkContext.broadcast((whole.column("term").combine_chunks(), whole.column("pc").to_numpy()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, shares = shared.value
        for b in batches:
            at = pc.index_in(b.column("terms").flatten(), value_set=terms).to_numpy(zero_copy_only=False)
            ends = b.column("terms").offsets.to_numpy()
            ends = pa.array(ends - ends[0], pa.int32())
            lists_ = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(at, pa.int64()), b.column("tfs").flatten(), pa.array(shares[at]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists_], schema=pa.schema([("doc_id", pa.int64()), *[(c, pa.list_(t)) for c, t in (("terms", pa.int64()), ("tfs", pa.int64()), ("pcs", pa.float64()))]]))

    return lists.mapInArrow(number, KNOWN), whole.num_rows


def modelled(docs: DataFrame, weight: float, iterations: int, more: float, queries: bool, block: int = BLOCK) -> DataFrame:
    """Blocks of documents' dense models. As queries they hold the terms' probabilities and, each, the sum of these times the background
    shares; else what a query's probability of the term is multiplied with where the document has it."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                flat = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs", "pcs")}
                many = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)
                own, start = np.repeat(np.arange(len(many)), many), np.concatenate([[0], np.cumsum(many)[:-1]])
                tf, share = flat["tfs"].astype(float), flat["pcs"]
                p = tf / np.add.reduceat(tf, start)[own]
                for _ in range(iterations):
                    p = p * weight
                    p = tf * p / (share + p)
                    p = p / np.add.reduceat(p, start)[own]
                held = p > 0
                term, p, share, own = flat["terms"][held], p[held], share[held], own[held]
                if not queries:
                    p = np.logaddexp(share, np.log(p) + more) - share
                ends, base = np.searchsorted(own, np.arange(len(many) + 1)), np.bincount(own, p * share, len(many))
                ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                row = {"no": int(ids[0]), "ids": ids.tobytes(), "ends": ends.astype(np.int64).tobytes(), "terms": term.astype(np.int32).tobytes(), "vals": p.tobytes(), "base": base.tobytes()}
                yield pa.RecordBatch.from_pylist([row], search._schema(MODELS))

    return materialize(docs.mapInArrow(fit, MODELS), "models")


def ranked(lists: DataFrame, vocab: DataFrame, queries: str, weight: float = 0.1, iterations: int = 50) -> DataFrame:
    """(q, doc_id, ce, rank): every document ranked for each query by ascending cross-entropy to 9 digits, then id; see `weighting.cross_entropy`."""
    docs, n_terms = known(lists, vocab, weight)
    models = modelled(docs, weight, iterations, 0.1, False)
    n_docs = lists.where("doc_id is not null and size(terms) > 0").count()
    asking = docs.where(queries)
    few = max(1, HELD // (8 * max(1, n_docs)))
    asking = modelled(asking.repartition(1 + asking.count() // few), weight, iterations, 0.1, True)
    tasks = max(1, asking.count())
    digits = 10.0**9

    files = [mounted(lists.sparkSession, f) for f in models.inputFiles()]
    if None in files:  # a store that workers cannot read as files: the same by frames of rows
        counts = search.counts(lists.where("doc_id is not null"))
        model = materialize(plm(restrict(counts, vocab, whole=True), vocab, weight, iterations, None, dense=True), "dense")
        return rank_models(cross_entropy(model.where(queries), model, background(vocab, weight)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from of_block({c: b.column(c)[k].as_py() for c in b.schema.names})

    def of_block(block: dict) -> Iterator[pa.RecordBatch]:
        q, ends = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["ends"], np.int64)
        terms, row = np.unique(np.frombuffer(block["terms"], np.int32), return_inverse=True)
        dense = np.zeros((len(terms), len(q)))
        dense[row, np.repeat(np.arange(len(q)), np.diff(ends))] = np.frombuffer(block["vals"])
        at = np.full(n_terms, -1, np.int32)
        at[terms] = np.arange(len(terms))
        ce, ids, filled = np.empty((n_docs, len(q))), np.empty(n_docs, np.int64), 0
        for f in files:
            for b in pq.ParquetFile(f).iter_batches(batch_size=8, columns=["ids", "ends", "terms", "vals"]):
                for k in range(b.num_rows):
                    mine, ends, row, w = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in (("ids", np.int64), ("ends", np.int64), ("terms", np.int32), ("vals", np.float64)))
                    row = at[row]
                    met = row >= 0
                    ends = np.concatenate([[0], np.cumsum(met)])[ends]
                    row, w = row[met], w[met]
                    ids[filled : filled + len(mine)] = mine
                    for n, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), filled):
                        np.matmul(w[lo:hi], dense[row[lo:hi]], out=ce[n])
                    filled += len(mine)
        if filled != n_docs:
            raise RuntimeError(f"{filled} of {n_docs} documents met")
        ce += np.frombuffer(block["base"])
        order = np.argsort(ids)
        ids = ids[order]
        for n, one in enumerate(q):
            x = ce[order, n]
            by = np.argsort(-np.floor(x * digits + 0.5), kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n_docs, one)), pa.array(ids[by]), pa.array(-x[by]), pa.array(np.arange(1, n_docs + 1, dtype=np.int32))], ["q", "doc_id", "ce", "rank"])

    return asking.repartitionByRange(tasks, "no").mapInArrow(rank, RANKED)
