"""Usage meters, tiers and per-task invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import any_of
from tallyloom.operators.metrics import MetricArgs
from tallyloom.schema import IDENTITY, is_event
from tallyloom.sources.events import fold_copies, insert_order, scan_events

METERS = ("events_ingested", "tasks_tracked", "agent_runs", "tasks_completed")

# Tier name, monthly price, and limits on events, tasks and runs.
TIERS = (
    ("free", 0, 50_000, 10_000, 500),
    ("starter", 200, 1_000_000, 50_000, 1_000),
    ("growth", 800, 10_000_000, 500_000, 10_000),
)
LIMITS = ("events_ingested", "tasks_tracked", "agent_runs")

# Per-task pricing.
USD_PER_TASK = 0.05
INCLUDED_TASKS = 1000


def usage_meters(events: DataFrame, args: MetricArgs, deduped: bool = False) -> DataFrame:
    """All four meters per tenant.

    Two plain groupings, (tenant, task, run) then (tenant, task), replace three
    distinct counts over the raw rows.
    """
    rows = scan_events(events, args.scope).select(*dict.fromkeys([*IDENTITY, "task_id", "run_id", *insert_order(events)]))
    if not deduped:
        rows = fold_copies(rows)
    runs = rows.groupBy("tenant_id", "task_id", "run_id").agg(
        F.count(F.lit(1)).alias("n"), any_of(is_event("task_completed")).alias("done"))
    tasks = runs.groupBy("tenant_id", "task_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("runs"), any_of(F.col("done")).alias("done"))
    return tasks.groupBy("tenant_id").agg(
        F.sum("n").alias("events_ingested"),
        F.count(F.lit(1)).alias("tasks_tracked"),
        F.sum("runs").alias("agent_runs"),
        F.count_if(F.col("done")).alias("tasks_completed"),
    )


def usage_meter(events: DataFrame, meter: str, args: MetricArgs, deduped: bool = False) -> DataFrame:
    if meter not in METERS:
        raise ValueError(f"unknown usage meter: {meter}")
    return usage_meters(events, args, deduped).select("tenant_id", F.col(meter).alias("value"))


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(TIERS), "tier string, price_usd_month int, max_events_ingested long, max_tasks_tracked long, max_agent_runs long")


def _covers(tier) -> F.Column:
    _, _, *limits = tier
    cond = F.lit(True)
    for meter, limit in zip(LIMITS, limits):
        cond = cond & (F.col(meter) <= limit)
    return cond


def resolve_tier(usage: DataFrame) -> DataFrame:
    """Cheapest tier that covers all three meters; the dearest one if none does.

    The tier list is a handful of constants, so it becomes one CASE and no join.
    """
    ranked = sorted(TIERS, key=lambda t: t[1])
    name, price = F.lit(ranked[-1][0]), F.lit(ranked[-1][1])
    for tier in reversed(ranked):
        name = F.when(_covers(tier), tier[0]).otherwise(name)
        price = F.when(_covers(tier), tier[1]).otherwise(price)
    return usage.withColumn("tier", name).withColumn("price_usd_month", price)


def plan_status(usage: DataFrame, accounts: DataFrame, unknown: str = "free") -> DataFrame:
    """Limits and over-limit flag for the tier each tenant is on; unknown tiers count as free."""
    named = usage.join(accounts.select("tenant_id", F.col("tier").alias("_t")), "tenant_id", "left")
    known = [t[0] for t in TIERS]
    tier = F.when(F.col("_t").isin(known), F.col("_t")).otherwise(unknown)
    out = named.withColumn("tier", tier).drop("_t")
    pick = lambda i: F.coalesce(*[F.when(F.col("tier") == t[0], F.lit(t[i])) for t in TIERS])
    out = out.withColumn("price_usd_month", pick(1))
    over = F.lit(False)
    for i, meter in enumerate(LIMITS, start=2):
        out = out.withColumn(f"limit_{meter}", pick(i).cast("long"))
        over = over | (F.col(meter) > F.col(f"limit_{meter}"))
    return out.withColumn("over_limit", over)


def task_invoice(usage: DataFrame, count_col: str = "tasks_completed",
                 usd_per_task: float = USD_PER_TASK, included: int = INCLUDED_TASKS) -> DataFrame:
    """Billable tasks and amount; a negative count stops the job."""
    n = F.col(count_col)
    checked = F.when(n < 0, F.raise_error(F.lit("completed task count must not be negative")).cast("long")).otherwise(n)
    billable = F.greatest(F.lit(0).cast("long"), checked - F.lit(included))
    return usage.select(
        "tenant_id",
        checked.alias("completed_tasks"),
        billable.alias("billable_tasks"),
        F.round(billable * F.lit(usd_per_task), 2).alias("amount_usd"),
        F.lit("tasks_completed").alias("meter"),
    )
