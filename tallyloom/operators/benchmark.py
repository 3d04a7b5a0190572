"""Opt-in cross-tenant benchmark with a minimum cohort size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import half_up

MIN_COHORT = 5


def benchmark(contributions: DataFrame, optin: DataFrame, k: int = MIN_COHORT, by=("metric",)) -> DataFrame:
    """Per metric and opted-in tenant: cohort mean and deviation, and the tenant's own rank.

    Input is (metric, tenant_id, value), one row per tenant. Below ``k``
    contributors nothing but the count and the reason is published, and no
    figure that could equal one tenant's value (min, max, quantile) ever is.
    Values are computed once: rank and figures are windows over one row per tenant.
    """
    by = list(by)
    own = contributions.where(F.col("value").isNotNull()).join(optin.select("tenant_id").distinct(), "tenant_id", "left_semi")
    every, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("value")
    own = own.select(
        *by, "tenant_id", F.count(F.lit(1)).over(every).alias("n"), F.avg("value").over(every).alias("_mean"),
        F.stddev_pop("value").over(every).alias("_sd"), (F.rank().over(ordered) - 1).alias("_below"))
    ok = F.col("n") >= k
    share = half_up(F.col("_below") / F.col("n") * 100)
    return (
        own.select(
            *by, "tenant_id", "n", (~ok).alias("suppressed"),
            F.when(~ok, F.format_string(f"insufficient cohort: %d contributors, need at least {k}", "n")).alias("reason"),
            F.when(ok, half_up(F.col("_mean"), 4)).alias("mean"),
            F.when(ok, half_up(F.col("_sd"), 4)).alias("stddev"),
            F.when(ok, F.greatest(share, F.lit(1.0)).cast("int")).alias("own_percentile"),
        )
    )
