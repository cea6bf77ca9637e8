"""Problem 8: mixing sources to target weights, by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calamus.functions.hashing import key
from calamus.functions.text import token_count
from calamus.llm.records import running_sum
from calamus.session import broadcast_if_small, materialize


def _source():
    return F.lower(F.trim("source"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, shuffle): texts with a source, and their place in a fixed shuffled order."""
    return docs.where(F.col("source").isNotNull()).select(
        "doc_id", _source().alias("source"), F.coalesce(token_count(F.col("text")), F.lit(0)).alias("n_tokens"), key("mix", F.col("doc_id")).alias("shuffle")
    )


def schedule(docs: DataFrame, targets: DataFrame, budget: int | None = None, per_task: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Weighted fair queueing of document copies. Returns

    * the schedule (mix_name, doc_id, source, copies): how often each document is taken in each mix;
    * the report (mix_name, source, target_share, max_copies, size, total, tokens, share, reachable, short): what each
      source has reached. `short` is true where the queue has handed out every copy of a source and that is less than its
      share of `total`, the budget; `reachable` is the largest budget at which the source keeps its share, so with the
      least of a mix's as `budget` all its targets hold. With a larger one, others fill up what a short source leaves.

    Documents of a source stand in shuffled order, copy after copy; the virtual finish time of a copy is the tokens of its
    source up to and including it, divided by the source's weight. Copies of a mix are taken in the order of finish time
    until the budget (the tokens of all documents with a source, unless given) is spent. Running sums are made per (source,
    hash bucket) and per time slice, both as many as make about `per_task` rows each, so a source with a third of all texts
    is spread like any other; only sums per source (as many as mix_targets has) are joined back.

    Defined results: texts with a NULL source belong to no mix; NULL texts have size 0 and are taken as their turn comes;
    sources are compared trimmed and in lower case; a source named in a mix without documents is reported with size 0;
    target rows that repeat a (mix, source) count once; NULL or non-positive shares take nothing; other columns are ignored.
    """
    sized = materialize(sized_documents(docs), "p8-sized")
    wanted = (
        targets.where(F.col("mix_name").isNotNull() & F.col("source").isNotNull())
        .select("mix_name", _source().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_copies", F.lit(0)).cast("int").alias("max_copies"))
        .dropDuplicates(["mix_name", "source"])
    )
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    whole = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).first()
    n_docs, total = whole["n"], whole["total"] if budget is None else budget
    goals = materialize(wanted.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("total", F.lit(total).cast("bigint")), "p8-goals")
    digits = max(1, math.ceil(math.log(max(n_docs / per_task, 1), 16)))
    queued = running_sum(sized.withColumn("bucket", F.substring("shuffle", 1, digits)), ["source"], "bucket", ["shuffle", "doc_id"], "n_tokens", "at")
    copies = (
        queued.join(broadcast_if_small(goals.where((F.col("target_share") > 0) & (F.col("max_copies") > 0))), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("max_copies"))))
        .withColumn("finish", ((F.col("copy") - 1) * F.col("size") + F.col("at")) / F.col("target_share"))
        .select("mix_name", "source", "doc_id", "n_tokens", "copy", "finish", "total")
    )
    # Slices of the finish time stand for the range partitions of a global sort. Copies lie evenly in time until a source is
    # used up, and more thinly then; so slices are even up to the budget and grow with the logarithm beyond it.
    slices = max(16, n_docs // per_task)
    time = F.col("finish") / F.lit(float(max(total, 1)))
    sliced = copies.withColumn("slice", F.floor(slices * F.when(time <= 1, time).otherwise(1 + F.log2(time))).cast("bigint"))
    spent = running_sum(sliced, ["mix_name"], "slice", ["finish", "source", "doc_id", "copy"], "n_tokens", "spent")
    taken = materialize(
        spent.where(F.col("spent") <= F.col("total")).groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.sum("n_tokens").alias("tokens")),
        "p8-taken",
    )
    reached = taken.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"))
    mix = Window.partitionBy("mix_name")
    tokens = F.coalesce("tokens", F.lit(0))
    report = (
        goals.join(reached, ["mix_name", "source"], "left")
        .withColumn("tokens", tokens)
        .withColumn("_all", F.sum("tokens").over(mix))
        .withColumn("share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(F.lit(0.0)))
        .withColumn("_most", F.col("max_copies") * F.col("size"))
        .withColumn("reachable", F.when(F.col("target_share") > 0, F.floor(F.col("_most") / F.col("target_share"))))
        # What the queue says, then the exact comparison.
        .withColumn("short", (F.col("tokens") >= F.col("_most")) & (F.col("target_share") * F.col("total") > F.col("_most")))
        .select("mix_name", "source", "target_share", "max_copies", "size", "total", "tokens", "share", "reachable", "short")
    )
    return taken.select("mix_name", "doc_id", "source", "copies"), report
