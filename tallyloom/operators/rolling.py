"""Rolling aggregates of raw metric readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import ROWS_PER_BLOCK, with_previous
from tallyloom.functions.order_stats import sliding

WINDOW_MS = 60_000
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rolling_aggregate(df: DataFrame, name: str, ts: str, value: str, tie: str | None = None,
                      window_ms: int = WINDOW_MS, percentiles: bool = True, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """After each reading: last, min, max, avg, sum, count, percentiles and trend of the trailing window.

    The window holds all readings of the last ``window_ms`` up to this one.
    Readings are cut in blocks by counts, so one busy metric is spread over many
    tasks; percentiles come from histograms of value ranges and a look at the
    ranges in question (``order_stats.sliding``), and may be left out.
    """
    order = [ts] + ([tie] if tie else [])
    rows = df.select(name, *order, F.col(value).cast("double").alias("value")).withColumn("_at", _us(ts))
    got = sliding(rows, [name], "_at", order[1:], "value", window_ms * 1000, PERCENTILES if percentiles else {}, rows_per_block)
    return got.select(
        name, *order, "value", F.col("_min").alias("min"), F.col("_max").alias("max"), F.try_divide(F.col("_sum"), F.col("_count").cast("double")).alias("avg"),
        F.col("_sum").alias("sum"), F.col("_count").alias("count"), *[F.col(f"_{n}").alias(n) for n in (PERCENTILES if percentiles else ())],
        metric_trend(F.col("_recent")).alias("trend"))


def metric_trend(values: Column) -> Column:
    """Second half of the last ten values against the first half: beyond 5% is up or down."""
    last = F.when(F.size(values) > 10, F.slice(values, -10, 10)).otherwise(values)
    half = F.floor(F.size(last) / 2).cast("int")
    mean = lambda a, n: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), n.cast("double"))
    first = mean(F.slice(last, F.lit(1), half), half)
    second = mean(F.slice(last, half + 1, F.size(last)), F.size(last) - half)
    change = F.try_divide((second - first) * 100, first)
    return F.when(F.size(values) < 3, "stable").when(change > 5, "up").when(change < -5, "down").otherwise("stable")


def metric_rate(df: DataFrame, name: str, ts: str, value: str, tie: str | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Change per second since the previous reading; 0 on the first one and between equal times."""
    order = [ts] + ([tie] if tie else [])
    prev = with_previous(df.select(name, *order, value), [name], order, [ts, value], rows_per_block)
    seconds = (_us(ts) - _us(f"prev_{ts}")) / 1_000_000.0
    rate = F.when(seconds > 0, F.try_divide(F.col(value) - F.col(f"prev_{value}"), seconds)).otherwise(0.0)
    return prev.select(name, *order, value, rate.alias("rate"))


def metric_history(df: DataFrame, ts: str, now: str, duration_ms: int) -> DataFrame:
    """Raw readings of the last ``duration_ms`` before ``now``."""
    at = F.lit(now).cast("timestamp_ntz")
    return df.where((F.col(ts) >= at - F.expr(f"INTERVAL '{duration_ms / 1000:.3f}' SECOND")) & (F.col(ts) <= at))
