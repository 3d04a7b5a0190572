"""Retention, erasure, compaction and rollup repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.metrics import daily_rollup_build
from tallyloom.sources.events import dedupe_events, read_event_table, write_event_table

CITATION_RETENTION_DAYS = 400


def alive(now: Column, ts: str = "timestamp", days: str = "retention_days") -> Column:
    """The row is still inside its retention window."""
    return F.col(ts) + F.make_dt_interval(days=F.col(days)) > now


def expire_events(events: DataFrame, now: Column) -> DataFrame:
    return events.where(alive(now))


def expire_citations(log: DataFrame, now: Column, days: int = CITATION_RETENTION_DAYS) -> DataFrame:
    return log.where(F.col("executed_at") + F.make_dt_interval(days=F.lit(days)) > now)


def erase_tenant(table: DataFrame, tenant: str) -> DataFrame:
    if not tenant:
        raise ValueError("a tenant is required")
    return table.where(F.col("tenant_id") != tenant)


def erase_end_users(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Drop the events of the requested (tenant_id, session_id) pairs; the rest is untouched."""
    pairs = requests.where((F.col("tenant_id") != "") & (F.col("session_id") != "")).select("tenant_id", "session_id").distinct()
    return events.join(pairs, ["tenant_id", "session_id"], "left_anti")


def touched_days(rows: DataFrame) -> DataFrame:
    return rows.select("tenant_id", F.to_date("timestamp").alias("day")).distinct()


def rebuild_days(rollup: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """The rollup with the given (tenant, day) pairs computed anew from the de-duplicated events."""
    keys = ["tenant_id", "day"]
    base = events.withColumn("day", F.to_date("timestamp")).join(days, keys, "left_semi").drop("day")
    return rollup.join(days, keys, "left_anti").unionByName(daily_rollup_build(dedupe_events(base)))


def erase_end_users_from_rollup(rollup: DataFrame, events: DataFrame, requests: DataFrame) -> DataFrame:
    """Rollup after an erasure: the days of the erased events are rebuilt from what remains."""
    gone = events.join(requests.select("tenant_id", "session_id").distinct(), ["tenant_id", "session_id"], "left_semi")
    return rebuild_days(rollup, erase_end_users(events, requests), touched_days(gone))


def repair_late_days(rollup: DataFrame, events: DataFrame, late: DataFrame) -> DataFrame:
    """``events`` already holds the late rows; only their days are rebuilt."""
    return rebuild_days(rollup, events, touched_days(late))


def reconcile_rollup(rollup: DataFrame, events: DataFrame, digits: int = 6) -> DataFrame:
    """Keys whose rollup differs from the raw events (or is missing on a side); empty when they agree."""
    keys = ["tenant_id", "task_type", "day"]
    raw = daily_rollup_build(dedupe_events(events))
    counts = ["completed", "ended", "abandoned", "events"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in counts], F.round("cost_usd", digits).alias(f"{p}_cost_usd"))
    j = side(rollup, "rollup").join(side(raw, "raw"), keys, "full_outer")
    differs = F.lit(False)
    for c in [*counts, "cost_usd"]:
        differs = differs | ~F.col(f"rollup_{c}").eqNullSafe(F.col(f"raw_{c}"))
    return j.where(differs)


# ---- in place, on the month-partitioned table -----------------------------

def _files(spark: SparkSession, path: str):
    """The file system of a path, and its Path class."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _swap(spark: SparkSession, path: str) -> list[str]:
    """Puts the months of a finished rewrite in place of the old ones; does nothing where there is none.

    The plan, written last, is the point of no return: before it the table is
    untouched, after it every step can be done again. A month goes by deleting
    the old folder and renaming the new one, so a month whose new folder is gone
    from the side has been swapped already.
    """
    fs, to = _files(spark, path)
    side = f"{path}{_SIDE}"
    if not fs.exists(to(f"{side}/plan/_SUCCESS")):
        fs.delete(to(side), True)
        return []
    months = {r["month"]: r["left"] for r in spark.read.parquet(f"{side}/plan").collect()}  # one row per month
    for month, left in months.items():
        new, old = to(f"{side}/rows/month={month}"), to(f"{path}/month={month}")
        if fs.exists(new) or not left:
            fs.delete(old, True)
        if fs.exists(new):
            fs.rename(new, old)
    fs.delete(to(side), True)
    spark.catalog.refreshByPath(path)
    return sorted(months)


_SIDE = "-rewrite"


def replace_months(spark: SparkSession, path: str, rows: DataFrame, months: DataFrame) -> list[str]:
    """Replaces whole months of the table by ``rows``; ``months`` holds (month, left), left being 0 where no row remains.

    ``rows`` may be read from the table itself. A failure at any point leaves
    either the old table or a plan that the next call, or ``recover``, completes.
    """
    recover(spark, path)
    side = f"{path}{_SIDE}"
    write_event_table(rows, f"{side}/rows")
    months.select("month", "left").coalesce(1).write.parquet(f"{side}/plan")
    return _swap(spark, path)


def recover(spark: SparkSession, path: str) -> list[str]:
    """Completes or drops a rewrite that was cut off; the months it completed."""
    return _swap(spark, path)


def rewrite_table(spark: SparkSession, path: str, keep: Column) -> list[str]:
    """Keep only the rows that satisfy ``keep``; rewrites just the months that lose any.

    The month list is the only thing that reaches the driver.
    """
    recover(spark, path)
    table = read_event_table(spark, path)
    doomed = ~F.coalesce(keep, F.lit(False))
    stats = table.groupBy("month").agg(F.count_if(doomed).alias("gone"), F.count_if(~doomed).alias("left")).where(F.col("gone") > 0)
    months = [(r["month"], r["left"]) for r in stats.collect()]
    if not months:
        return []
    rows = table.where(F.col("month").isin([m for m, _ in months]) & ~doomed).drop("month")
    return replace_months(spark, path, rows, spark.createDataFrame(months, "month string, left long"))


def compact_events(spark: SparkSession, path: str, months: Sequence[str], order_col: str | None = None) -> None:
    """Fold duplicates and small files of the given months."""
    recover(spark, path)
    part = read_event_table(spark, path).where(F.col("month").isin(*months)).drop("month")
    replace_months(spark, path, dedupe_events(part, order_col), spark.createDataFrame([(m, 1) for m in months], "month string, left long"))
