"""Problem 2: occurrences and records of every distinct term, by recursive radix spilling."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calamus.llm.records import record_counts
from calamus.session import broadcast_if_small, materialize, mounted, shared_path

PARTIAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
ROWS = "term string, occurrences bigint, records bigint"


def _connect(spill: str | None, memory: str):
    """A DuckDB database that spills into a folder of its own: below `spill` where the shared folder is mounted, else below
    the folders this executor spills its own shuffles to, if the cluster names any."""
    import duckdb

    root = spill or next((d for v in ("LOCAL_DIRS", "SPARK_LOCAL_DIRS", "SPARK_EXECUTOR_DIRS") for d in os.environ.get(v, "").split(",") if d), None)
    if root is None:
        return duckdb.connect(":memory:", config={"memory_limit": memory, "threads": 1}), None
    own = f"{root}/duck-{uuid.uuid4().hex}"
    os.makedirs(own, exist_ok=True)
    return duckdb.connect(f"{own}/t.db", config={"memory_limit": memory, "threads": 1, "temp_directory": f"{own}/tmp"}), own


def _aggregator(spill: str | None, memory: str, flush_rows: int | None):
    """Sum partial rows of a task with DuckDB. With `flush_rows`, what has been gathered is given out whenever so many rows
    have come (a map-side combine); without, once at the end (the final sums of a leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, own = _connect(spill, memory)
        try:
            con.execute("create table part (term varchar, occurrences bigint, records bigint)")

            def drain() -> Iterator[pa.RecordBatch]:
                found = con.execute("select term, sum(occurrences)::bigint occurrences, sum(records)::bigint records from part group by term")
                for x in found.to_arrow_reader(50_000) if hasattr(found, "to_arrow_reader") else found.fetch_record_batch(50_000):
                    yield pa.RecordBatch.from_arrays([x.column(i).cast(PARTIAL.field(i).type) for i in range(3)], schema=PARTIAL)

            held = 0
            for batch in batches:
                con.register("piece", pa.Table.from_batches([batch]))
                con.execute("insert into part select term, occurrences, records from piece")
                con.unregister("piece")
                held += batch.num_rows
                if flush_rows and held >= flush_rows:
                    yield from drain()
                    con.execute("delete from part")
                    held = 0
            yield from drain()
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return run


def term_frequencies(corpus: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", **radix) -> DataFrame:
    """(term, occurrences, records) over all records, by `radix_sums` of the counts made inside each record.

    Defined results: NULL tokens take no part, NULL, empty and letterless elements yield no term, repeated records count
    once, an empty table gives no row; other columns are ignored.
    """
    return radix_sums(_partial_rows(record_counts(corpus, id_col, tokens_col)), **radix)


def _partial_rows(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("term").isNotNull()).select("term", F.col("tf").alias("occurrences"), F.lit(1).cast("bigint").alias("records"))


def radix_sums(rows: DataFrame, bits: int = 4, leaf_rows: int = 1_000_000, max_bits: int = 32, memory: str = "400MB", flush_rows: int = 1_000_000) -> DataFrame:
    """(term, occurrences, records): sums per term.

    Rows are combined per task, then written to disk by the first `bits` hash bits of the term, one folder per value. A
    partition with more than `leaf_rows` partial rows is an inner node: its rows are written again by the next bits, and
    so on. The sizes are a table that is joined back, never collected. Each leaf is then a task of its own, summed up
    out-of-core by DuckDB: leaves are numbered and a row goes to the task with its leaf's number. A hot term is one partial row per
    task that met it, so no leaf depends on its frequency. Splitting ends at `max_bits`; a leaf still larger (few terms
    from very many tasks) is right as well, DuckDB spills.
    """
    spark = rows.sparkSession
    root = shared_path(spark, "radix")
    spill = mounted(spark, root)
    level, used, leaves = rows.mapInArrow(_aggregator(spill, memory, flush_rows), ROWS), 0, []
    while True:
        used += bits
        path = f"{root}/bits{used}"
        part = F.shiftrightunsigned(F.xxhash64("term"), 64 - used)
        own = F.pmod("part", F.lit(1 << bits)).cast("int")  # the value of this level's bits
        level.withColumn("part", part).withColumn("p", own).write.option("compression", "zstd").partitionBy("p").parquet(path)
        written = spark.read.schema(f"{ROWS}, part bigint, p int").parquet(path).drop("p")
        sizes = materialize(written.groupBy("part").count(), "radix-sizes")
        inner = sizes.where(F.col("count") > leaf_rows).select("part")
        if used + bits > max_bits or inner.isEmpty():
            leaves.append((used, written, sizes))
            break
        leaves.append((used, written.join(broadcast_if_small(inner), "part", "left_anti"), sizes.where(F.col("count") <= leaf_rows)))
        level = written.join(broadcast_if_small(inner), "part", "left_semi").drop("part")
    named = [(x.withColumn("level", F.lit(u)), s.select(F.lit(u).alias("level"), "part")) for u, x, s in leaves]
    every, numbers = named[0]
    for x, s in named[1:]:
        every, numbers = every.unionByName(x), numbers.unionByName(s)
    # One row per leaf, so fewer than the partial rows divided by leaf_rows times 2^bits.
    numbers = materialize(numbers.withColumn("leaf", (F.row_number().over(Window.orderBy("level", "part")) - 1).cast("int")), "radix-leaves")
    count = max(1, numbers.count())
    placed = every.join(broadcast_if_small(numbers), ["level", "part"])
    return placed.repartitionById(count, F.col("leaf")).select("term", "occurrences", "records").mapInArrow(_aggregator(spill, memory, None), ROWS)


def marked_terms(corpus: DataFrame, common_share: int = 4, id_col: str = "doc_id", tokens_col: str = "tokens", **radix) -> DataFrame:
    """Every term with its counts and `mark`: `rare` in exactly one record, `common` in more than 1/`common_share` of all
    records, else NULL."""
    n = corpus.where(F.col(tokens_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col).distinct().count()
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") * common_share > n, "common")
    return term_frequencies(corpus, id_col, tokens_col, **radix).withColumn("mark", mark)
