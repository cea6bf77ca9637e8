"""Smoothing of a signal given as rows (pos, x), pos consecutive from 0."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = ("flat", "hanning", "hamming", "bartlett", "blackman")


def window_weights(length: int, window: str) -> list[float]:
    """The window's weights, summing up to 1."""
    n = length - 1
    shape = {
        "flat": lambda k: 1.0,
        "hanning": lambda k: 0.5 - 0.5 * math.cos(2 * math.pi * k / n),
        "hamming": lambda k: 0.54 - 0.46 * math.cos(2 * math.pi * k / n),
        "bartlett": lambda k: 1 - abs(2 * k / n - 1),
        "blackman": lambda k: 0.42 - 0.5 * math.cos(2 * math.pi * k / n) + 0.08 * math.cos(4 * math.pi * k / n),
    }[window]
    raw = [shape(k) for k in range(length)]
    total = sum(raw)
    return [w / total for w in raw]


def smooth(signal: DataFrame, length: int = 10, window: str = "hanning") -> DataFrame:
    """(pos, y): the signal convolved with a window, its ends continued by odd reflection. The left end's reflection leaves
    out the value at 1, the right end's repeats the last value (kept). A length under 3 returns the signal; a signal
    shorter than the window is an error. One weight per shift: a join of positions, not a window over the whole signal."""
    if window not in WINDOWS:
        raise ValueError(f"window must be one of {WINDOWS}")
    if length < 3:
        return signal.select("pos", F.col("x").alias("y"))
    weights = window_weights(length, window)
    n = signal.count()
    if n < length:
        raise ValueError("the signal must be at least as long as the window")
    ends = signal.agg(F.max(F.when(F.col("pos") == 0, F.col("x"))).alias("_first"), F.max(F.when(F.col("pos") == n - 1, F.col("x"))).alias("_last"))
    both = signal.crossJoin(F.broadcast(ends))
    # Padded positions run from 0; the signal begins at length - 1.
    pad = length - 1
    left = both.where((F.col("pos") >= 2) & (F.col("pos") <= length)).select((F.lit(length) - F.col("pos")).alias("at"), (2 * F.col("_first") - F.col("x")).alias("x"))
    right = both.where(F.col("pos") >= n - pad).select((F.lit(pad + n + n - 1) - F.col("pos")).alias("at"), (2 * F.col("_last") - F.col("x")).alias("x"))
    padded = left.unionByName(signal.select((F.col("pos") + pad).alias("at"), "x")).unionByName(right)
    shift = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)]))
    moved = padded.select("at", "x", shift.alias("s")).select((F.col("at") + F.col("s.k") - (length - 1) // 2 - pad).alias("pos"), (F.col("x") * F.col("s.w")).alias("v"))
    return moved.where((F.col("pos") >= 0) & (F.col("pos") < n)).groupBy("pos").agg(F.sum("v").alias("y"))
