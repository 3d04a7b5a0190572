"""Reading, de-duplicating, laying out and routing the flat event table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schema import IDENTITY

ALL_TENANTS = "*"


@dataclass(frozen=True)
class Scope:
    """Whose rows, and which half-open window [start, end)."""

    tenant: str
    start: str
    end: str

    def __post_init__(self):
        if not self.tenant:
            raise ValueError("a tenant is required; use ALL_TENANTS for a job over every tenant")

    def predicate(self, columns: Sequence[str]) -> Column:
        ts = F.col("timestamp")
        cond = (ts >= F.lit(self.start).cast("timestamp_ntz")) & (ts < F.lit(self.end).cast("timestamp_ntz"))
        if "month" in columns:
            # a predicate on timestamp alone does not prune the derived partition column
            cond = cond & (F.col("month") >= self.start[:7]) & (F.col("month") <= self.end[:7])
        if self.tenant != ALL_TENANTS:
            cond = cond & (F.col("tenant_id") == self.tenant)
        return cond


def scan_events(events: DataFrame, scope: Scope) -> DataFrame:
    """Tenant and half-open time scan; filters reach the Parquet scan."""
    return events.where(scope.predicate(events.columns))


def dedupe_events(events: DataFrame, order_col: str | None = None, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """One row per dedup identity.

    Without ``order_col`` the copies are taken to be equal (at-least-once
    delivery). With it the last insert wins. Both are plain aggregates, so the
    copies of one event are folded before the shuffle and a group of copies
    that holds a large share of the table does not land in one task as rows.
    """
    keys = list(keys)
    if order_col is None:
        return events.dropDuplicates(keys)
    rest = [c for c in events.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    return (
        events.groupBy(*keys)
        .agg(F.max_by(packed, F.col(order_col)).alias("_last"))
        .select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in events.columns])
    )


#: Time or number of the insert, where a table records it; of differing copies the last insert wins.
INSERTED = "inserted_at"


def insert_order(events: DataFrame) -> list[str]:
    return [INSERTED] if INSERTED in events.columns else []


def fold_copies(events: DataFrame) -> DataFrame:
    """One row per identity: the last insert where the table records it, else any of the equal copies."""
    return dedupe_events(events, *insert_order(events))


def with_month(events: DataFrame) -> DataFrame:
    return events.withColumn("month", F.date_format("timestamp", "yyyy-MM"))


LAYOUT = ("month", "tenant_id", "task_type", "event", "timestamp", "event_id")


def write_event_table(events: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Query-aligned layout: month partitions, rows sorted by tenant, task type, event, time.

    Writers take ranges of the sort order. Their number comes from the bytes
    that the exchange measures (adaptive execution joins small ranges), so a
    month or a tenant of any size gets as many writers as it needs and a file
    holds few tenants. ``rows_per_file`` bounds a file.
    """
    rows = with_month(events).repartitionByRange(*LAYOUT).sortWithinPartitions(*LAYOUT)
    rows.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("month").parquet(path)


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def route_by_residency(events: DataFrame, col: str = "residency") -> DataFrame:
    """'eu' goes to the eu store, everything else (missing too) to 'us'; no row is dropped."""
    return events.withColumn("store", F.when(F.col(col) == "eu", "eu").otherwise("us"))


def content_token(batch: DataFrame) -> DataFrame:
    """One-row content token of a batch, independent of row order and partitioning.

    Row hashes are summed as decimals, which is associative, so the token is a
    partial aggregate and no row travels.
    """
    row = F.struct(*[F.col(c) for c in sorted(batch.columns)])
    h1 = F.xxhash64(row).cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit(17), row).cast("decimal(38,0)")
    return batch.agg(
        F.sha2(
            F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(h1).cast("string"), F.sum(h2).cast("string")), 256
        ).alias("token")
    )


def new_rows(batch: DataFrame, table: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Rows of the batch whose identity the table does not hold yet, once each."""
    keys = list(keys)
    return batch.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
