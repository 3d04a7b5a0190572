"""Rollups over the operations tables and registry comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.quantiles import grouped_quantiles
from tallyloom.operators.billing import TIERS

# Onboarding milestones, latest first, and the step each one leads to.
MILESTONES = (
    ("first_finding_at", "active"), ("first_event_at", "awaiting_first_finding"), ("plan_approved_at", "awaiting_data"),
    ("plan_proposed_at", "review_plan"), ("connected_at", "awaiting_plan"),
)
FIRST_STEP = "connect_repo"


def merge_rate(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("delivered"), F.count_if(F.col("outcome").isin("merged", "edited_then_merged")).alias("merged"))


def rejections_by_reason(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("reason").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "reason")


def onboarding_state(timeline: DataFrame) -> DataFrame:
    """Current step per tenant and the time from connection to the first finding."""
    step: Column = F.lit(FIRST_STEP)
    for column, name in reversed(MILESTONES):
        step = F.when(F.col(column).isNotNull(), name).otherwise(step)
    took = F.unix_millis(F.col("first_finding_at").cast("timestamp")) - F.unix_millis(F.col("connected_at").cast("timestamp"))
    return timeline.select("tenant_id", step.alias("current_step"), took.alias("time_to_first_finding_ms"))


def onboarding_funnel(states: DataFrame) -> DataFrame:
    """Tenants per step, and the median time to the first finding over all of them (on every row)."""
    steps = states.groupBy("current_step").agg(F.count(F.lit(1)).alias("tenants"))
    median = grouped_quantiles(states, [], "time_to_first_finding_ms", {"median_time_to_first_finding_ms": 0.5})
    return steps.withColumn("_k", F.lit(1)).join(median.withColumn("_k", F.lit(1)), "_k").drop("_k")


def revenue_rollup(accounts: DataFrame, invoices: DataFrame) -> DataFrame:
    """Accounts and monthly price per tier, and the invoiced total (on every row)."""
    price = F.lit(0)
    for name, usd, *_ in TIERS:
        price = F.when(F.col("tier") == name, usd).otherwise(price)
    tiers = accounts.groupBy("tier").agg(F.count(F.lit(1)).alias("accounts")).withColumn("recurring_usd_month", price * F.col("accounts"))
    total = invoices.agg(F.coalesce(F.sum("amount_usd"), F.lit(0.0)).alias("invoiced_usd_total"))
    return tiers.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")


def tenant_summary(tenants: DataFrame, states: DataFrame, grants: DataFrame, accounts: DataFrame, entries: DataFrame) -> DataFrame:
    """Per tenant: onboarding step, latest autonomy level (default 0), tier (default free), registry entry counts."""
    level = grants.groupBy("tenant_id").agg(F.max_by("level", "grant_id").alias("_level"))
    tier = accounts.groupBy("tenant_id").agg(F.max("tier").alias("_tier"))
    count = entries.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "active").alias("_a"), F.count_if(F.col("status") == "deprecated").alias("_d"))
    j = tenants.select("tenant_id", "name")
    for part in (states.select("tenant_id", "current_step"), level, tier, count):
        j = j.join(part, "tenant_id", "left")
    zero = F.lit(0).cast("long")
    return j.select(
        "tenant_id", "name", F.coalesce("current_step", F.lit(FIRST_STEP)).alias("onboarding_step"), F.coalesce("_level", F.lit(0)).alias("autonomy_level"),
        F.coalesce("_tier", F.lit("free")).alias("tier"), F.coalesce("_n", zero).alias("entries"), F.coalesce("_a", zero).alias("active"), F.coalesce("_d", zero).alias("deprecated"))


def latest(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Newest ``n`` rows per key; Spark limits each group before the shuffle already."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def registry_diff(local: DataFrame, remote: DataFrame, key: str = "event", by: Sequence[str] = ()) -> DataFrame:
    """added (local only), modified (differs), removed (active remote only); deprecated remote entries are left alone."""
    keys = [*by, key]
    rest = [c for c in local.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    j = pack(local, "l").join(pack(remote, "r"), keys, "full_outer")
    change = (F.when(F.col("r").isNull(), "added").when(F.col("l").isNull(), F.when(F.col("r.status") == "active", "removed"))
              .when(~F.col("l").eqNullSafe(F.col("r")), "modified"))
    return j.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def registry_fingerprint(entries: DataFrame, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Content hash of the entries of each key, whatever their order.

    Entry hashes are added up in four 32-bit lanes, so it is a partial
    aggregate and no list of entries is gathered.
    """
    cols = sorted(c for c in entries.columns if c not in by)
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")).cast("string") for i in range(4)]
    return entries.withColumn("_h", h).groupBy(*by).agg(
        F.concat(F.lit("fp_"), F.substring(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *lanes), 256), 1, 16)).alias("fingerprint"))
