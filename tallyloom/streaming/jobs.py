"""Structured Streaming jobs: ingest, de-duplication, rollup, rolling metrics, funnels, cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.jsonrules import quoted, with_fields
from tallyloom.functions.quantiles import grouped_quantiles
from tallyloom.operators import anomaly, cohorts, funnels
from tallyloom.operators.metrics import exact_sum
from tallyloom.operators.redact import redact_json
from tallyloom.operators.validate import enrich_with_settings, validate_events
from tallyloom.operators.rolling import PERCENTILES, metric_trend
from tallyloom.schema import IDENTITY, ended, is_event
from tallyloom.sources.events import content_token, dedupe_events, new_rows, with_month
from tallyloom.sources.otlp import span_outcomes
from tallyloom.sources.rows import map_messages
from tallyloom.streaming.sink import read_batches, write_batch


def event_stream(spark: SparkSession, source: str, schema: T.StructType | str | None = None, fmt: str = "text", **options: str) -> DataFrame:
    """A stream of messages from the start of the source.

    Files by default; ``fmt='kafka'`` reads a topic (the connector has to be on
    the classpath) with ``source`` as the topic name.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.option("subscribe", source).option("startingOffsets", "earliest").load().select(
            F.col("key").cast("string"), F.col("value").cast("string"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(source)


def prepare_messages(batch: DataFrame, settings: DataFrame, payload: str = "payload") -> DataFrame:
    """Validate, attach the tenant's settings, redact, map: one row per message with all verdicts.

    Takes (tenant_id, payload). The tenant comes from the connection, never
    from the message.
    """
    v = enrich_with_settings(validate_events(batch, payload), settings)
    full = with_fields(F.col(payload), {
        "tenant_id": quoted(F.col("tenant_id")), "retention_days": F.col("retention_days").cast("string"), "residency": quoted(F.col("residency"))})
    v = v.withColumn("_full", F.when(F.col("reason_class").isNull(), full))
    v = v.withColumn("value", F.when(F.col("redact"), redact_json(F.col("_full"))).otherwise(F.col("_full"))).drop("_full")
    return map_messages(v, "value")


def ingest_batch(spark: SparkSession, batch: DataFrame, batch_id: int, settings: DataFrame, out: str, payload: str = "payload",
                 unmapped: DataFrame | None = None) -> None:
    """One micro-batch: accepted rows, dead letters and rejection counts, each in its batch folder.

    Accepted rows are split by the residency store of their tenant. Of copies
    within the batch the last one wins; a batch that comes again under a new id
    adds no rows. ``unmapped`` spans (tenant_id) count as rejections.
    """
    _ingest(spark, _spread(batch.select("tenant_id", payload)), batch_id, settings, out, payload, unmapped)


def _spread(batch: DataFrame) -> DataFrame:
    """The batch with the order of its rows (``_at``), dealt over all cores.

    The number of partitions does not tell where the rows are: a file is cut by
    bytes, but its rows are read by row group, so most of the parts may be empty.
    Dealing the texts costs little beside reading them.
    """
    rows = batch.withColumn("_at", F.monotonically_increasing_id())
    return rows.repartition(4 * max(rows.rdd.getNumPartitions(), batch.sparkSession.sparkContext.defaultParallelism), "_at")


def _ingest(spark: SparkSession, rows: DataFrame, batch_id: int, settings: DataFrame, out: str, payload: str, unmapped: DataFrame | None = None) -> None:
    """``ingest_batch`` of rows with their order; rows with a ``refused`` class of their own are rejections, too."""
    prepared = prepare_messages(rows, settings, payload)
    if "refused" in rows.columns:
        prepared = prepared.withColumn("reason_class", F.coalesce("refused", "reason_class"))
    valid = F.col("reason_class").isNull()
    # the message is in its row already; only dead letters are kept beside
    prepared = prepared.select(
        "tenant_id", "reason_class", F.when(F.col("residency") == "eu", "eu").otherwise("us").alias("store"), F.when(valid, F.col("row")).alias("row"), "dead_reason",
        F.when(valid & F.col("row").isNull(), F.col("value")).alias("original"), "_at").persist()
    try:
        accepted = prepared.where(valid)
        events = accepted.where(F.col("row").isNotNull()).select("row.*", "store", "_at")
        write_events_idempotent(spark, dedupe_events(events, "_at").drop("_at"), f"{out}/events", batch_id)
        write_batch(accepted.where(F.col("row").isNull()).select(F.col("dead_reason").alias("reason"), "original"), f"{out}/dead", batch_id)
        bad = prepared.where(~valid).select("tenant_id", "reason_class")
        if unmapped is not None:
            bad = bad.unionByName(unmapped.select("tenant_id", F.lit("unmapped_span").alias("reason_class")))
        write_batch(bad.groupBy("tenant_id", "reason_class").agg(F.count(F.lit(1)).alias("rejected")), f"{out}/rejections", batch_id)
    finally:
        prepared.unpersist()


def ingest_spans_batch(spark: SparkSession, batch: DataFrame, batch_id: int, settings: DataFrame, out: str, payload: str = "payload", namespace: str = "agent") -> None:
    """A batch of trace payloads (tenant_id, payload) on the path of all messages: mapped, validated, redacted, mapped to rows."""
    made = span_outcomes(_spread(batch.select("tenant_id", payload)), payload, ("tenant_id", "_at"), namespace)
    # messages of one payload keep their order behind that of the payloads
    made = made.select(
        "tenant_id", "payload", F.struct("_at", F.monotonically_increasing_id().alias("i")).alias("_at"), F.when(F.col("reason").isNotNull(), "unmapped_span").alias("refused"))
    _ingest(spark, made, batch_id, settings, out, "payload")


def write_events_idempotent(spark: SparkSession, batch: DataFrame, path: str, batch_id: int) -> bool:
    """Write a batch so that a replay changes nothing, under its own id or another one; False if nothing was written.

    The token of a batch is a hash of its whole content. It is looked up first:
    a batch that another id has brought already is left out without reading any
    row of the table. A new batch is compared with the rows of its own months
    only. The same id overwrites its folder. The token is logged after the rows,
    so a batch cut off in between is written again.
    """
    log, rows = f"{path}-tokens", with_month(batch).persist()
    try:
        token = content_token(rows.drop("month")).first()["token"]
        if _there(spark, log) and not spark.read.parquet(log).where((F.col("token") == token) & (F.col("by_batch") != batch_id)).isEmpty():
            return False
        fresh = rows.dropDuplicates(list(IDENTITY))
        if _there(spark, path):
            months = [r["month"] for r in rows.select("month").distinct().collect()]  # one row per month of the batch
            known = T.StructType([rows.schema[c] for c in (*IDENTITY, "month")] + [T.StructField("batch_id", T.LongType())])
            table = spark.read.schema(known).parquet(path).where(F.col("month").isin(months) & (F.col("batch_id") != batch_id))
            fresh = new_rows(rows, table)
        write_batch(fresh, path, batch_id, ["month"])
        write_batch(spark.range(1).select(F.lit(token).alias("token"), F.lit(batch_id).alias("by_batch")), log, batch_id)
        return True
    finally:
        rows.unpersist()


def dedupe_stream(events: DataFrame, delay: str = "10 minutes", keys: Sequence[str] = IDENTITY, ts: str = "timestamp") -> DataFrame:
    """Drop redeliveries that arrive within the delay; later ones fold at read."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def rollup_stream(events: DataFrame, delay: str = "1 day", ts: str = "timestamp") -> DataFrame:
    """Incremental daily rollup, for update mode: each batch emits the days it changed."""
    return events.withWatermark(ts, delay).groupBy("tenant_id", "task_type", F.window(ts, "1 day").alias("w")).agg(
        F.count_if(is_event("task_completed")).alias("completed"), F.count_if(ended()).alias("ended"),
        F.count_if(is_event("task_abandoned")).alias("abandoned"), exact_sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("events"),
    ).select("tenant_id", "task_type", F.to_date("w.start").alias("day"), "completed", "ended", "abandoned", "cost_usd", "events")


def closed_readings_stream(readings: DataFrame, name: str, ts: str, value: str, width: str = "60 seconds", slide: str = "60 seconds",
                           delay: str = "1 minute") -> DataFrame:
    """Readings (name, at, ts, value, times) of each window, for append mode: all at once when it is closed.

    Equal readings are one row. The state is one small row per different reading
    of the open windows, hashed over all tasks: a busy metric has no state of its
    own that grows, and the state store may keep the rows on disk. Windows go
    from the state with the watermark. ``window_metrics`` takes the batches.
    """
    return readings.withWatermark(ts, delay).groupBy(F.col(name).alias(name), F.window(ts, width, slide).alias("w"), F.unix_micros(ts).alias("_us"), F.col(value).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("times")).select(name, F.col("w.start").alias("at"), F.timestamp_micros("_us").alias("ts"), "value", "times")


def window_metrics(closed: DataFrame, name: str) -> DataFrame:
    """Per metric and closed window: last, min, max, value (mean), sum, count, nearest-rank p50 to p99, rate and trend.

    ``rate`` is the change per second between the last two readings, 0 if there
    is one or both have the same time; ``trend`` looks at the last ten. Readings
    of equal time are in order of value. Null values count as readings, only in
    ``count``. No window is gathered: percentiles come from counts by value
    range, and each task passes on its ten last readings of a window.
    """
    keys = [name, "at"]
    given = F.col("value").isNotNull()
    total = closed.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum(F.col("value") * F.col("times")).alias("sum"), F.sum("times").alias("count"),
        F.sum(F.when(given, F.col("times"))).alias("_given"))
    ranks = grouped_quantiles(closed, keys, "value", PERCENTILES, "times", nearest=True)
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("value").desc())
    # ten different readings hold the ten last ones; a reading that came more than ten times needs no more than ten places
    tail = closed.where(given).withColumn("_i", F.row_number().over(newest)).where("_i <= 10").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("ts", "value", F.least("times", F.lit(10)).cast("int").alias("n")))).alias("_tail"))
    tail = tail.withColumn("_tail", F.flatten(F.transform(
        "_tail", lambda r: F.array_repeat(F.struct(r["ts"].alias("ts"), r["value"].alias("value")), r["n"]))))
    tail = tail.withColumn("_tail", F.when(F.size("_tail") > 10, F.slice("_tail", -10, 10)).otherwise(F.col("_tail")))
    out = _beside(_beside(total, ranks, keys), tail, keys)
    now, before = F.try_element_at("_tail", F.lit(-1)), F.try_element_at("_tail", F.lit(-2))
    seconds = (F.unix_micros(now["ts"]) - F.unix_micros(before["ts"])) / 1_000_000.0
    return out.select(
        *keys, now["value"].alias("last"), "min", "max", F.try_divide("sum", F.col("_given").cast("double")).alias("value"), "sum", "count", *PERCENTILES,
        F.when(seconds > 0, F.try_divide(now["value"] - before["value"], seconds)).otherwise(0.0).alias("rate"),
        metric_trend(F.coalesce(F.transform("_tail", lambda r: r["value"]), F.array().cast("array<double>"))).alias("trend"))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(r, match, "left").drop(*[f"_k_{k}" for k in keys])


def baseline_batch(spark: SparkSession, windows: DataFrame, batch_id: int, name: str, out: str) -> None:
    """Continue every metric's baseline over the closed windows of a batch.

    The state is a table with one row per metric and batch; a batch starts from
    the newest state below its own id, so running it again gives the same
    result. Within the batch the recurrence is blocked, not folded per metric.
    """
    initial = None
    if batch_id > 0 and _there(spark, f"{out}/state"):
        past = spark.read.parquet(f"{out}/state").where(F.col("batch_id") < batch_id)
        initial = past.groupBy(name).agg(F.max_by(F.struct("points", "mean", "std_dev"), "batch_id").alias("s")).select(name, "s.*")
    rows = anomaly.update_baseline(windows, name, "at", F.to_date("at"), initial).persist()
    try:
        write_batch(rows, f"{out}/baselines", batch_id)
        write_batch(rows.groupBy(name).agg(F.max_by(F.struct("points", "mean", "std_dev"), "at").alias("s")).select(name, "s.*"), f"{out}/state", batch_id)
    finally:
        rows.unpersist()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def funnel_stream(events: DataFrame, steps: Sequence[funnels.Step], user: str = "user_id", ts: str = "ts", type_col: str = "event_type",
                  properties: str = "props", delay: str = "1 day") -> DataFrame:
    """Latest time and hits of every funnel step per user and day, for update mode. The first step an event matches counts.

    Days leave the state with the watermark, so it holds the users of the open
    days only; ``funnel_latest`` adds the days up.
    """
    step = F.lit(None).cast("string")
    for s in reversed(list(steps)):
        step = F.when(funnels.step_match(s, type_col, properties), s.id).otherwise(step)
    hits = events.select(user, ts, step.alias("step_id")).where(F.col("step_id").isNotNull()).withWatermark(ts, delay)
    return hits.groupBy(user, "step_id", F.window(ts, "1 day").alias("w")).agg(F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("hits")).select(
        user, "step_id", F.to_date("w.start").alias("day"), "last_at", "hits")


def funnel_latest(days: DataFrame, user: str = "user_id") -> DataFrame:
    """Latest time and hits of every step per user from the last version of each day."""
    return days.groupBy(user, "step_id").agg(F.max("last_at").alias("last_at"), F.sum("hits").alias("hits"))


def cohort_stream(events: DataFrame, cohort: DataFrame, user: str = "user_id", ts: str = "ts", type_col: str = "event_type", amount: str = "value",
                  delay: str = "1 day") -> DataFrame:
    """Weekly activity of known cohort users, for update mode: stream-static join, then counters per calendar day.

    A period starts at a user's own time, so its counters are kept by day and
    leave the state with the watermark; ``cohorts.whole_periods`` adds them up.
    """
    got = cohorts.period_activity(events.withWatermark(ts, delay), cohort, "week", user, ts, type_col, amount, parts=[F.window(ts, "1 day").alias("w")])
    return got.withColumn("day", F.to_date("w.start")).drop("w", "engagement")


__all__ = [
    "baseline_batch", "closed_readings_stream", "cohort_stream", "dedupe_stream", "event_stream", "funnel_latest", "funnel_stream", "ingest_batch",
    "ingest_spans_batch", "prepare_messages", "read_batches", "rollup_stream", "window_metrics", "write_events_idempotent",
]
