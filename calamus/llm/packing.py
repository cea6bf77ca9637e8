"""Problem 7: texts into containers of fixed capacity, by exact-complement hashing of lengths."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calamus.functions.text import token_count
from calamus.llm.records import running_sum
from calamus.session import materialize

Pattern = tuple[int, ...]


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Container patterns (lengths, descending) and how often each is used, from the number of items of each length.

    Longest first, the gap an item leaves is looked up among the lengths left: a single, a pair or a triple that fills it
    exactly is used as often as counts allow. What remains is placed best-fit, longest first, whole runs of equal lengths
    into containers with equal gaps at a time. Work depends on the capacity, not on the number of items.
    """
    left = Counter({k: v for k, v in counts.items() if 0 < k <= capacity and v > 0})
    out: list[tuple[Pattern, int]] = []

    def use(items: Pattern) -> bool:
        need = Counter(items)
        times = min(left[k] // n for k, n in need.items())
        if times <= 0:
            return False
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((items, times))
        return True

    if left[capacity]:
        use((capacity,))
    for first in sorted(left, reverse=True):
        if first not in left:
            continue
        gap = capacity - first
        if gap in left:
            use((first, gap))
        # Pairs: each half is looked up once, the larger first.
        for a in [x for x in sorted(left, reverse=True) if x < gap and x <= first]:
            if first not in left:
                break
            if a < gap - a:
                break
            if a in left and gap - a in left:
                use((first, a, gap - a))
        if first in left:
            sums: dict[int, tuple[int, int]] = {}
            keys = [x for x in sorted(left, reverse=True) if x < gap and x <= first]
            for i, a in enumerate(keys):
                for b in keys[i:]:
                    sums.setdefault(a + b, (a, b))
            for c in keys:
                if first not in left:
                    break
                if (ab := sums.get(gap - c)) and c in left and all(x in left for x in ab):
                    use((first, *sorted((*ab, c), reverse=True)))
    # Best fit of the rest: containers by gap, each gap with its patterns.
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            gap = min((g for g in open_ if g >= length and open_[g]), default=None)
            if gap is None:
                fit = capacity // length
                if n >= fit:
                    times, items = n // fit, (length,) * fit
                else:
                    times, items = 1, (length,) * n
                n -= times * len(items)
                open_[capacity - sum(items)].append((items, times))
                continue
            items, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            took = min(n, times)
            if took < times:
                open_[gap].append((items, times - took))
            open_[gap - length].append(((*items, length), took))
            n -= took
    return out + [x for group in open_.values() for x in group]


def pack(docs: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> DataFrame:
    """(id, piece, n_tokens, container): every text assigned to containers of `capacity` T1 tokens. A text longer than a
    container is cut into full pieces and a rest; no other text is cut.

    Only the number of pieces of each length goes to the driver (at most `capacity` rows). The plan comes back as runs of
    ranks per length, and each piece finds its container from its rank among pieces of the same length; ranks are made of
    counts per (length, hash bucket), so a length that a third of all pieces share is no single task's work.

    Defined results: NULL texts and texts without tokens take no space and get no row; every id row counts (texts repeated
    under other ids too); an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("_id"), token_count(F.col(text_col)).alias("_n")).where(F.col("_n") > 0)
    whole = F.ceil(F.col("_n") / F.lit(capacity)).cast("int")
    pieces = materialize(
        sized.select("_id", "_n", F.explode(F.sequence(F.lit(1), whole)).alias("piece"))
        .select("_id", "piece", F.least(F.lit(capacity), F.col("_n") - (F.col("piece") - 1) * capacity).cast("int").alias("len"))
        .withColumn("_bucket", F.pmod(F.xxhash64("_id", "piece"), F.lit(buckets)).cast("int")),
        "p7-pieces",
    )
    counts = {r["len"]: r["count"] for r in pieces.groupBy("len").count().collect()}
    runs, used, container = [], Counter(), 0
    for items, times in plan_patterns(counts, capacity):
        for length in items:
            runs.append((length, used[length], used[length] + times, container))
            used[length] += times
        container += times
    plan = spark.createDataFrame(runs, "len int, lo bigint, hi bigint, first bigint")
    one = pieces.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_sum(one, ["len"], "_bucket", ["_id", "piece"], "_one", "_rank").withColumn("_rank", F.col("_rank") - 1)
    # The plan's runs depend on the capacity alone. They are grouped per length, so that the join is an equality.
    by_length = plan.groupBy("len").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first"))).alias("_runs"))
    hit = F.filter("_runs", lambda r: (r["lo"] <= F.col("_rank")) & (F.col("_rank") < r["hi"]))[0]
    return (
        ranked.join(F.broadcast(by_length), "len")
        .withColumn("_run", hit)
        .select(F.col("_id").alias(id_col), "piece", F.col("len").cast("bigint").alias("n_tokens"), (F.col("_run.first") + F.col("_rank") - F.col("_run.lo")).alias("container"))
    )


def divided(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_pieces): texts that needed more than one container, counted over their assigned containers."""
    return packed.groupBy(id_col).agg(F.count_distinct("container").alias("n_pieces")).where(F.col("n_pieces") > 1)


def fill_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """(containers, tokens, fill, lower_bound): how full the containers are, and the least number there could be."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.round(F.avg("t") / capacity, 6).alias("fill"), F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).alias("lower_bound"),
    )
