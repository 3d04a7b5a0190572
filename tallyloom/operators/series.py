"""Statistical primitives over any number of metric series at once.

A series is (keys, order, value) with one row per time bucket; NULL is an
explicit gap. History is always strictly before the point, gaps are skipped,
and fewer than five earlier points give "insufficient", never a guess.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.blocks import ROWS_PER_BLOCK, side_moments
from tallyloom.functions.order_stats import expanding
from tallyloom.functions.scalars import div

MIN_HISTORY = 5
INF = float("inf")


def _verdict(df: DataFrame, keys, order, value, score: Column, anomalous: Column, extra: Sequence[Column]) -> DataFrame:
    """NULL stays NULL; too little history is said so; else the score decides."""
    v = F.col(value)
    enough = F.col("h_n") >= MIN_HISTORY
    judged = v.isNotNull() & enough
    scored = df.withColumn("score", F.when(judged, score).when(v.isNotNull(), F.lit(0.0)))
    return scored.select(
        *keys, order, value,
        F.when(v.isNotNull(), ~enough).alias("insufficient"),
        "score",
        F.when(judged, anomalous).when(v.isNotNull(), F.lit(False)).alias("anomalous"),
        *[F.when(judged, c).alias(n) for n, c in extra],
    )


def anomaly_zscore(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float = 3.0,
                   block: Column | None = None) -> DataFrame:
    v, mu, sd = F.col(value), F.col("h_mean"), F.col("h_std")
    score = F.when(sd == 0, F.when(v == mu, F.lit(0.0)).otherwise(F.lit(INF))).otherwise(div(F.abs(v - mu), sd))
    base = side_moments(df.select(*keys, order, value), keys, order, value, "h", block=block)
    return _verdict(base, keys, order, value, score, F.col("score") > threshold, [("mean", mu), ("std_dev", sd)])


def anomaly_mad(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float = 3.5, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    v, med, mad = F.col(value), F.col("h_median"), F.col("h_mad")
    score = F.when(mad == 0, F.when(v == med, F.lit(0.0)).otherwise(F.lit(INF))).otherwise(
        div(F.lit(0.6745) * F.abs(v - med), mad))
    base = expanding(df.select(*keys, order, value), keys, order, value, {"median": 0.5}, mad=True, rows_per_block=rows_per_block)
    return _verdict(base, keys, order, value, score, F.col("score") > threshold, [("median", med), ("mad", mad)])


def anomaly_iqr(df: DataFrame, keys: Sequence[str], order: str, value: str, k: float = 1.5, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    v, q1, q3 = F.col(value), F.col("h_q1"), F.col("h_q3")
    iqr = q3 - q1
    lower, upper = q1 - F.lit(k) * iqr, q3 + F.lit(k) * iqr
    out = (v < lower) | (v > upper)
    dist = F.when(v > upper, v - upper).when(v < lower, lower - v).otherwise(F.lit(0.0))
    score = F.when(iqr == 0, F.when(out, F.lit(INF)).otherwise(F.lit(0.0))).otherwise(div(dist, iqr))
    base = expanding(df.select(*keys, order, value), keys, order, value, {"q1": 0.25, "q3": 0.75}, rows_per_block=rows_per_block)
    return _verdict(base, keys, order, value, score, out, [("q1", q1), ("q3", q3)])


def changepoint(df: DataFrame, keys: Sequence[str], order: str, value: str, min_significance: float = 3.0,
                side: int = 3, block: Column | None = None) -> DataFrame:
    """Best single level shift per series; a series without one gives no row.

    Every split is one row with the moments of both sides, so this is two
    blocked windows and a max; the first of equally good splits wins.
    """
    rows = df.select(*keys, order, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    both = side_moments(side_moments(rows, keys, order, value, "b", block=block), keys, order, value, "a", later=True, block=block)
    size = F.col("a_mean") - F.col("b_mean")
    se = F.sqrt(div(F.col("b_std") * F.col("b_std"), F.col("b_n")) + div(F.col("a_std") * F.col("a_std"), F.col("a_n")))
    sig = F.when(se == 0, F.lit(INF)).otherwise(div(F.abs(size), se))
    splits = (
        both.where((F.col("b_n") >= side) & (F.col("a_n") >= side))
        .select(*keys, order, F.col("b_n").alias("index"), size.alias("magnitude"), sig.alias("significance"))
        .where((F.col("magnitude") != 0) & (F.col("significance") >= min_significance))
    )
    best = F.max_by(F.struct(F.col(order), "index", "magnitude", "significance"),
                    F.struct(F.col("significance"), (-F.col("index")).alias("i")))
    return splits.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{order}", "_b.index", "_b.magnitude", "_b.significance")


def segment_contributions(df: DataFrame, group: Sequence[str], key: str, before: str, after: str) -> DataFrame:
    """Delta of each segment, its share of the total absolute change and its rank."""
    delta = F.col(after) - F.col(before)
    g = Window.partitionBy(*group)
    total = F.sum(F.abs(F.col("delta"))).over(g)
    ranked = df.select(*group, key, delta.alias("delta"))
    return ranked.select(
        *group, key, "delta",
        F.when(total == 0, F.lit(0.0)).otherwise(div(F.abs(F.col("delta")), total)).alias("share"),
        F.row_number().over(g.orderBy(F.abs(F.col("delta")).desc(), F.col(key))).alias("rank"),
    )


def rank_correlations(target: DataFrame, candidates: DataFrame, group: Sequence[str], order: str, value: str,
                      key: str = "candidate") -> DataFrame:
    """Pearson coefficient of each candidate series with the target of its group.

    Pairs are aligned on the order column, both sides must be present, n >= 3,
    and a constant side gives no row.
    """
    t = target.select(*group, order, F.col(value).alias("_t")).where(F.col("_t").isNotNull())
    c = candidates.select(*group, key, order, F.col(value).alias("_c")).where(F.col("_c").isNotNull())
    # the built-in correlation raises on a constant side under ANSI arithmetic
    r = F.try_divide(F.covar_pop("_t", "_c"), F.stddev_pop("_t") * F.stddev_pop("_c"))
    agg = t.join(c, [*group, order]).groupBy(*group, key).agg(
        r.alias("coefficient"), F.count(F.lit(1)).alias("n"),
        ((F.min("_t") != F.max("_t")) & (F.min("_c") != F.max("_c"))).alias("_varies"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.abs(F.col("coefficient")).desc(), F.col(key)))
    return agg.where((F.col("n") >= 3) & F.col("_varies")).drop("_varies").withColumn("rank", rank)
