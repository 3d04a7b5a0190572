"""Runs, trajectories and failure clusters, for every run at once.

A run is summarised by partial aggregates and its steps stay rows. Nothing
here gathers the events of a run in an array: one runaway run may hold a large
share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.blocks import ROWS_PER_BLOCK, numbered
from tallyloom.functions.scalars import div, short_sha
from tallyloom.schema import ended, human_touch, is_event
from tallyloom.sources.events import Scope, scan_events

RUN = ("tenant_id", "task_id", "run_id")
ORDER = ("timestamp", "event_id")
OUTCOMES = {"task_completed": "completed", "task_failed": "failed", "task_abandoned": "abandoned"}


def run_events(events: DataFrame, tenant: str, task: str, run: str) -> DataFrame:
    """Ordered events of one run."""
    if not tenant:
        raise ValueError("a tenant is required")
    one = (F.col("tenant_id") == tenant) & (F.col("task_id") == task) & (F.col("run_id") == run)
    return events.where(one).orderBy(*ORDER)


def _at() -> Column:
    return F.struct(*ORDER)


def reconstruct_runs(events: DataFrame) -> DataFrame:
    """One row per run: outcome, agents in order of first appearance, session or NULL, totals.

    Level one is (run, agent), so the only array built holds the distinct
    agents of a run.
    """
    step = is_event("step_executed")
    bad = step & (F.col("status") != "") & (F.col("status") != "ok")
    per_agent = events.groupBy(*RUN, "agent_name").agg(
        F.min(_at()).alias("first_at"),
        F.min_by("task_type", _at()).alias("task_type"),
        F.min(F.when(F.col("session_id") != "", F.struct(*ORDER, "session_id"))).alias("session"),
        F.max(F.when(ended(), F.struct(*ORDER, "event"))).alias("last_end"),
        F.count_if(step).alias("steps"),
        F.count_if(bad).alias("errors"),
        F.count_if(step & (F.col("retry_of_step_id") != "")).alias("retries"),
        F.sum(F.when(step, F.col("tokens_in") + F.col("tokens_out")).otherwise(0.0)).alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count_if(human_touch()).alias("human_events"),
        F.count(F.lit(1)).alias("events"),
    )
    runs = per_agent.groupBy(*RUN).agg(
        F.min_by("task_type", "first_at").alias("task_type"),
        F.min("session").alias("session"),
        F.max("last_end").alias("last_end"),
        F.array_sort(F.collect_list(F.when(F.col("agent_name") != "", F.struct("first_at", "agent_name")))).alias("agents"),
        *[F.sum(c).alias(c) for c in ("steps", "errors", "retries", "tokens", "cost_usd", "human_events", "events")],
    )
    outcome = F.lit("in_flight")
    for event, word in OUTCOMES.items():
        outcome = F.when(F.col("last_end.event") == event, word).otherwise(outcome)
    return runs.select(
        *RUN, "task_type", F.col("session.session_id").alias("session_id"), outcome.alias("outcome"),
        F.transform("agents", lambda a: a["agent_name"]).alias("agents"),
        "steps", "errors", "retries", "tokens", "cost_usd", "human_events", "events")


def _last_end() -> Column:
    return F.max(F.when(ended(), F.struct(*ORDER, "event")))


def trajectories(events: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The ordered steps of every run as rows: position, event, tool, status, retried step, and whether the run was completed.

    A run is completed when its last end says so. Blocks are cut by counts, so a
    runaway run is spread over tasks even if all of it happened in one day.
    """
    rows = events.select(*RUN, *ORDER, "event", *[
        F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("tool_name", "status", "retry_of_step_id")])
    out = numbered(rows, RUN, ORDER, facts={"_end": _last_end()}, rows_per_block=rows_per_block)
    return out.select(*rows.columns, "pos", F.coalesce(F.col("_end.event") == "task_completed", F.lit(False)).alias("completed"))


def run_steps(events: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The steps and human events of every run as rows beside its summary, in order.

    ``kind`` is step or human; ``pos`` counts each kind on its own. Human events
    carry their name and time only.
    """
    step = is_event("step_executed")
    detail = ("agent_name", "tool_name", "model", "status", "latency_ms", "tokens_in", "tokens_out", "cost_usd", "retry_of_step_id")
    rows = events.where(step | human_touch()).select(
        *RUN, F.when(step, "step").otherwise("human").alias("kind"), *ORDER, "event", *[F.when(step, F.col(c)).alias(c) for c in detail])
    return numbered(rows, (*RUN, "kind"), ORDER, rows_per_block=rows_per_block)


def _number(v: Column) -> Column:
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def waterfall(events: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Display rows of every run: bar share of the slowest step, label, detail, highlight."""
    step = is_event("step_executed")
    read = events.select(*RUN, *ORDER, "event", "tool_name", "model", "status", "latency_ms", "tokens_in", "tokens_out", "retry_of_step_id").where(step | human_touch())
    joined = numbered(read, RUN, ORDER, facts={"_slowest": F.max(F.when(step, F.col("latency_ms")))}, rows_per_block=rows_per_block)
    filled = lambda c: F.col(c) != ""
    tokens = F.col("tokens_in") + F.col("tokens_out")
    bad = filled("status") & (F.col("status") != "ok")
    detail = F.concat_ws(
        " · ",
        F.when(filled("model") & filled("tool_name"), F.col("model")),
        F.when(F.col("latency_ms") != 0, F.concat(_number(F.col("latency_ms")), F.lit("ms"))),
        F.when(tokens > 0, F.concat(_number(tokens), F.lit(" tok"))),
        F.when(bad, F.col("status")),
    )
    label = F.when(filled("tool_name"), F.col("tool_name")).when(filled("model"), F.col("model")).otherwise("step")
    return joined.select(
        *RUN, *ORDER,
        F.when(step, "step").otherwise("human").alias("kind"),
        F.when(step, label).otherwise(F.col("event")).alias("label"),
        F.when(step, detail).otherwise("").alias("detail"),
        F.when(step, div(F.col("latency_ms"), F.greatest(F.lit(1.0), F.col("_slowest")))).otherwise(0.0).alias("share"),
        F.when(~step, "human").when(bad, "error").when(filled("retry_of_step_id"), "retry").otherwise("none").alias("highlight"),
        "pos")


def failure_rows(events: DataFrame, scope: Scope) -> DataFrame:
    """Failed tool steps and human overrides in a window."""
    failed_tool = is_event("step_executed") & (F.col("status") != "ok") & (F.col("tool_name") != "")
    return scan_events(events, scope).where(failed_tool | is_event("human_overrode")).select(
        "tenant_id", "event", "task_type", "tool_name", "status", "task_id", "run_id", *ORDER)


def failure_members(rows: DataFrame) -> DataFrame:
    """Each failure with its cluster: signature, label and stable id. This lists the members, whole."""
    tool = is_event("step_executed") & (F.col("status") != "") & (F.col("status") != "ok") & (F.col("tool_name") != "")
    signature = F.when(tool, F.to_json(F.struct(
        F.lit("tool_failure").alias("kind"), "tool_name", "status", "task_type"))).when(
        is_event("human_overrode"), F.to_json(F.struct(F.lit("human_override").alias("kind"), "task_type")))
    label = F.when(tool, F.concat_ws(" ", "tool_name", "status", F.lit("on"), "task_type")).otherwise(
        F.concat(F.lit("human overrides on "), F.col("task_type")))
    return (
        rows.withColumn("signature", signature).where(F.col("signature").isNotNull())
        .withColumn("kind", F.when(tool, "tool_failure").otherwise("human_override"))
        .withColumn("label", label)
        .withColumn("cluster_id", short_sha("fc_", F.col("signature"), 12))
    )


def cluster_failures(rows: DataFrame) -> DataFrame:
    """Clusters with their member counts, largest first within a tenant (``rank``)."""
    clusters = failure_members(rows).groupBy("tenant_id", "cluster_id", "kind", "label", "task_type").agg(
        F.count(F.lit(1)).alias("member_count"))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("member_count"), "cluster_id")
    return clusters.withColumn("rank", F.row_number().over(w))


def cluster_findings(clusters: DataFrame, query_id: str) -> DataFrame:
    """Finding per cluster; its one number cites the query of the failure rows."""
    count = F.col("member_count").cast("string")
    cite = F.lit(query_id)
    return clusters.select(
        "tenant_id", "cluster_id",
        F.when(F.col("kind") == "human_override", "A").otherwise("O").alias("layer"),
        F.when(F.col("member_count") >= 10, "critical").otherwise("warning").alias("severity"),
        F.lit("anomaly").alias("variant"),
        F.concat(F.lit("Repeated failure: "), F.col("label"), F.lit(", seen in "), count, F.lit(" runs.")).alias("headline"),
        F.lit("Grouped by an exact failure signature; the member runs can be listed.").alias("summary"),
        F.array(F.struct(F.lit("member_runs").alias("label"), count.alias("value"), cite.alias("query_id"))).alias("metrics"),
        F.array(F.struct(F.concat(F.lit("Member runs of "), F.col("label")).alias("title"), cite.alias("query_id"))).alias("evidence"),
    )
