"""Exact grouped quantiles that never gather a group in one task.

``percentile`` keeps every distinct value of a group in the memory of one
reducer. Here the rows are first counted per (group, value) with map-side
combine; a coarse histogram of those counts then tells which value range holds
each wanted rank, and only the counts of that range are ordered. A group that
holds a third of all rows is spread over its value ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_range(v: Column) -> Column:
    """Monotone coarse bucket of a double: about 0.5% wide in relative terms at every magnitude, zero by itself."""
    # the smallest double is 2 to the power -1074, so the shifted logarithm is positive
    return F.coalesce(F.floor(F.signum(v) * (F.log2(F.abs(v)) + F.lit(1075.0)) * F.lit(128.0)), F.lit(0))


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], times: str | None = None, nearest: bool = False) -> DataFrame:
    """One row per group with one quantile per entry of ``probs``: linearly interpolated, or the ``nearest`` rank.

    A row counts once, or as often as its column ``times`` says.
    """
    by = list(by)
    first = lambda p: F.greatest(F.ceil(F.col("_n") * F.lit(float(p))) - 1, F.lit(0)).cast("double") if nearest else (F.col("_n") - 1) * F.lit(float(p))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("_c"))
        .withColumn("_b", value_range(F.col("_v")))
    )
    w = Window.partitionBy(*by).orderBy("_b")
    hist = (
        counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
        .withColumn("_upto", F.sum("_bc").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*by)))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(i).alias("side"),
                 (F.floor if i == 0 else F.ceil)(first(p)).cast("long").alias("rank"), first(p).alias("pos"))
        for name, p in probs.items() for i in (0, 1)
    ])
    targets = (
        hist.select(*by, "_b", "_bc", "_upto", F.explode(wanted).alias("t"))
        .where((F.col("t.rank") >= F.col("_upto") - F.col("_bc")) & (F.col("t.rank") < F.col("_upto")))
        .select(*by, "_b", F.col("t.q").alias("_q"), F.col("t.side").alias("_side"), F.col("t.pos").alias("_pos"),
                (F.col("t.rank") - (F.col("_upto") - F.col("_bc"))).alias("_off"))
    )
    ranges = targets.groupBy(*by, "_b").agg(
        F.collect_list(F.struct("_q", "_side", "_pos", "_off")).alias("_want")
    ).select(*[F.col(k).alias(f"_r_{k}") for k in by], F.col("_b").alias("_rb"), "_want")
    wv = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    match = F.col("_b") == F.col("_rb")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    picked = (
        counts.join(ranges, match)
        .select(*by, "_b", "_v", "_c", "_want")
        .withColumn("_cum", F.sum("_c").over(wv))
        .select(*by, "_v", "_c", "_cum", F.explode("_want").alias("w"))
        .where((F.col("w._off") >= F.col("_cum") - F.col("_c")) & (F.col("w._off") < F.col("_cum")))
    )
    aggs = []
    for name in probs:
        lo = F.max(F.when((F.col("w._q") == name) & (F.col("w._side") == 0), F.col("_v")))
        hi = F.max(F.when((F.col("w._q") == name) & (F.col("w._side") == 1), F.col("_v")))
        pos = F.max(F.when(F.col("w._q") == name, F.col("w._pos")))
        aggs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.groupBy(*by).agg(*aggs)
