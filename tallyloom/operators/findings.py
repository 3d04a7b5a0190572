"""Sweeps, digests and alerts as table jobs over all tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import as_count, as_pct, as_points, as_usd, div, guarded_div
from tallyloom.operators import metrics as M
from tallyloom.operators.series import anomaly_zscore
from tallyloom.schema import IDENTITY, ended, is_event
from tallyloom.sources.events import fold_copies, insert_order, scan_events


def regression_sweep(tenants: DataFrame, events: DataFrame, args: M.MetricArgs, threshold: float = 0.05,
                     deduped: bool = False) -> DataFrame:
    """Success rate, its change at the pivot and the worst tool, per tenant.

    A tenant without ended tasks is ``no_new_data``; a change below the
    threshold is ``no_finding``; nothing is made up for either.
    """
    for name in ("task_success_rate", "regression_delta", "per_tool_failure_rate"):
        M.check_args(name, args)
    rows = scan_events(events, args.scope).select(*IDENTITY, "tool_name", "status", *insert_order(events))
    if not deduped:
        rows = fold_copies(rows)
    after, done, step = args.after_pivot(), is_event("task_completed"), is_event("step_executed")
    # one scan serves all three metrics: counts per (tenant, tool), then per tenant
    per_tool = rows.groupBy("tenant_id", "tool_name").agg(
        F.count_if(ended()).alias("ended"), F.count_if(done).alias("done"),
        F.count_if(ended() & after).alias("ended_after"), F.count_if(done & after).alias("done_after"),
        F.count_if(step).alias("steps"), F.count_if(step & (F.col("status") != "ok")).alias("bad"),
    ).withColumn("rate", F.when(F.col("tool_name") != "", div(F.col("bad"), F.col("steps"))))
    ended_n, done_n = F.sum("ended"), F.sum("done")
    ended_a, done_a = F.sum("ended_after"), F.sum("done_after")
    order = F.when(F.col("rate").isNotNull(), F.struct((-F.col("rate")).alias("r"), F.col("tool_name").alias("t")))
    facts = per_tool.groupBy("tenant_id").agg(
        ended_n.alias("ended_tasks"), div(done_n, ended_n).alias("tsr"),
        (guarded_div(done_a, ended_a) - guarded_div(done_n - done_a, ended_n - ended_a)).alias("delta"),
        F.min(order).alias("_worst"),
    )
    facts = facts.select("tenant_id", "ended_tasks", "tsr", "delta", F.col("_worst.t").alias("worst_tool"),
                         (-F.col("_worst.r")).alias("worst_rate"))
    j = tenants.select("tenant_id").join(facts, "tenant_id", "left")
    no_data = F.coalesce(F.col("ended_tasks"), F.lit(0)) == 0
    quiet = F.abs(F.coalesce(F.col("delta"), F.lit(0.0))) < threshold
    status = F.when(no_data, "no_new_data").when(quiet, "no_finding").otherwise("published")
    found = F.col("status") == "published"
    ids = {n: M.query_id(n, args) for n in ("task_success_rate", "regression_delta", "per_tool_failure_rate")}
    checked = [F.lit(ids["task_success_rate"])]
    checked += [F.when(~no_data, F.lit(ids["regression_delta"])), F.when(F.col("status") == "published", F.lit(ids["per_tool_failure_rate"]))]
    return j.withColumn("status", status).select(
        "tenant_id", "status", F.array_compact(F.array(*checked)).alias("checked"),
        F.when(found, F.when(F.col("delta") < 0, "critical").otherwise("positive")).alias("severity"),
        F.when(found, as_pct(F.col("tsr"))).alias("task_success_rate"),
        F.when(found, as_points(F.col("delta"))).alias("regression_delta"),
        F.when(found, F.col("worst_tool")).alias("worst_tool"),
        F.when(found, as_pct(F.col("worst_rate"))).alias("worst_tool_failure_rate"),
        F.when(found, F.concat(F.lit("Task success moved "), as_points(F.col("delta")), F.lit(" at the pivot, to "), as_pct(F.col("tsr")), F.lit("."))).alias("headline"),
    )


# The digest rows, in order, with their display format.
DIGEST = (
    ("task_success_rate", "Task success rate", as_pct),
    ("cost_per_completed_task", "Cost / completed task", as_usd),
    ("autonomy_rate", "Autonomy rate", as_pct),
    ("override_rate", "Override/takeover rate", as_pct),
    ("weekly_task_actors", "Weekly task actors", as_count),
)


def weekly_digest(events: DataFrame, args: M.MetricArgs, deduped: bool = False) -> DataFrame:
    """Five formatted metrics per tenant with their citation ids; the weekly one is the latest week's."""
    rows = scan_events(events, args.scope)
    if not deduped:
        rows = fold_copies(rows)
    names = [n for n, _, _ in DIGEST if n in M.PANEL]
    panel = M.metric_panel(rows, args, names, deduped=True)
    weekly = M.metric("weekly_task_actors", rows, args, deduped=True)
    latest = weekly.groupBy("tenant_id").agg(F.max_by("value", "week").cast("double").alias("value")).select(
        "tenant_id", F.lit("weekly_task_actors").alias("metric"), "value")
    text: Column = F.lit(None).cast("string")
    label: Column = F.lit(None).cast("string")
    qid: Column = F.lit(None).cast("string")
    for name, title, fmt in DIGEST:
        is_it = F.col("metric") == name
        text = F.when(is_it, fmt(F.col("value"))).otherwise(text)
        label = F.when(is_it, title).otherwise(label)
        qid = F.when(is_it, M.query_id(name, args)).otherwise(qid)
    return panel.unionByName(latest).where(F.col("value").isNotNull()).select(
        "tenant_id", "metric", label.alias("label"), text.alias("text"), qid.alias("query_id"))


def threshold_alerts(panel: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts (alert_id, tenant_id, name, metric, above, below) judged against a metric panel.

    A missing or non-finite value is recorded as not fired, never as fine.
    """
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    over = F.coalesce(v > F.col("above"), F.lit(False))
    under = F.coalesce(v < F.col("below"), F.lit(False))
    fired = finite & (over | under)
    side = F.when(F.col("above").isNotNull(), F.format_string("above %.4f", "above")).otherwise(F.format_string("below %.4f", "below"))
    return alerts.join(panel.select("tenant_id", "metric", "value"), ["tenant_id", "metric"], "left").select(
        "alert_id", "tenant_id", "metric",
        F.coalesce(fired, F.lit(False)).alias("fired"),
        F.when(finite, v).alias("value"),
        F.when(~F.coalesce(finite, F.lit(False)), F.lit("no data in window")).when(
            fired, F.concat(F.col("name"), F.lit(": "), F.col("metric"), F.lit(" = "), F.format_string("%.4f", v), F.lit(" ("), side, F.lit(")"))).alias("message"),
    )


def anomaly_alerts(series: DataFrame, keys, order: str, value: str, threshold: float = 3.0) -> DataFrame:
    """The latest point of each series, judged against everything before it."""
    verdicts = anomaly_zscore(series, keys, order, value, threshold)
    last = F.max_by(F.struct(F.col(order), F.col(value).alias("value"), "score", "anomalous"), F.col(order))
    return verdicts.groupBy(*keys).agg(last.alias("_l")).select(
        *keys, f"_l.{order}", "_l.value", "_l.score", F.coalesce("_l.anomalous", F.lit(False)).alias("fired"))


def eval_regression_alerts(scores: DataFrame, alerts: DataFrame, default_drop: float = 0.1) -> DataFrame:
    """Mean score of the current window against the previous one, per evaluator.

    ``scores`` holds (evaluator_id, period, value) with period 'current' or
    'previous'; ``alerts`` holds (alert_id, evaluator_id, name, max_drop).
    """
    means = scores.groupBy("evaluator_id").agg(
        F.avg(F.when(F.col("period") == "current", F.col("value"))).alias("cur"),
        F.avg(F.when(F.col("period") == "previous", F.col("value"))).alias("prev"))
    drop = F.col("prev") - F.col("cur")
    fired = F.coalesce(drop > F.coalesce("max_drop", F.lit(default_drop)), F.lit(False))
    return alerts.join(means, "evaluator_id", "left").select(
        "alert_id", "evaluator_id", fired.alias("fired"),
        F.when(drop.isNotNull(), F.col("cur")).alias("value"),
        F.when(drop.isNull(), F.lit("insufficient eval scores to compare")).when(
            fired, F.concat(F.col("name"), F.lit(": mean score fell by "), F.format_string("%.3f (%.3f to %.3f)", drop, F.col("prev"), F.col("cur")))).alias("message"))


def record_evaluations(evaluations: DataFrame, path: str) -> None:
    """Append every evaluation, fired or not."""
    evaluations.withColumn("evaluated_at", F.current_timestamp()).write.mode("append").parquet(path)


def alert_history(recorded: DataFrame, n: int, at: str = "evaluated_at") -> DataFrame:
    """Newest ``n`` recorded evaluations per alert."""
    w = Window.partitionBy("alert_id").orderBy(F.desc(at))
    return recorded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
