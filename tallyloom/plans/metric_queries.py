"""Registered queries: sources over the event table, metrics, billing, benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import r6
from tallyloom.operators import benchmark as B
from tallyloom.operators import billing as BL
from tallyloom.operators import metrics as M
from tallyloom.plans.fixtures import END, IN_WINDOW, PIVOT, START, agent_events, oracle, table
from tallyloom.sources.events import ALL_TENANTS

ARGS = M.MetricArgs(ALL_TENANTS, START, END)
PIVOTED = M.MetricArgs(ALL_TENANTS, START, END, pivot=PIVOT)

ENDED = "event IN ('task_completed', 'task_failed', 'task_abandoned')"
TOUCH = "event IN ('handoff_to_human', 'human_approved', 'human_edited', 'human_overrode')"
DONE = "event = 'task_completed'"
STEP = "event = 'step_executed'"
START_EV = "event = 'task_started'"
AFTER = f"timestamp >= TIMESTAMP '{PIVOT}'"
SUNDAY = "CAST(CAST(timestamp AS DATE) - CAST(dayofweek(CAST(timestamp AS DATE)) AS INTEGER) AS DATE)"

_ROUNDED = {"value", "p50", "p95", "total_cost_usd"}


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if c in _ROUNDED and dict(df.dtypes)[c] == "double" else F.col(c)
                       for c in df.columns])


def _metric(name, args=ARGS):
    def run(spark, sf_dir):
        return _rounded(M.metric(name, agent_events(spark, sf_dir), args))
    return run


def _flat(select, where=None, keys=""):
    cond = IN_WINDOW + (f" AND {where}" if where else "")
    group = "tenant_id" + (f", {keys}" if keys else "")
    return oracle(f"SELECT {group}, {select} FROM agent_events WHERE {cond} GROUP BY {group}")


def _r(expr, alias="value"):
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def _c(cond):
    return f"count(*) FILTER (WHERE {cond})"


PER_TASK = f"""per_task AS (SELECT tenant_id, task_id,
  bool_or({DONE} AND verification = 'self_reported') AS self_rep,
  bool_or(event IN ('human_edited','human_overrode') OR (event = 'feedback_given' AND rating_value = 0)) AS contested,
  count(DISTINCT run_id) AS runs, bool_or({DONE}) AS completed, bool_or({TOUCH}) AS touched, bool_or({ENDED}) AS has_end
  FROM agent_events WHERE {IN_WINDOW} GROUP BY tenant_id, task_id)"""


def _task(select, where="true"):
    return oracle(f"SELECT tenant_id, {select} FROM per_task WHERE {where} GROUP BY tenant_id", PER_TASK)


QUERIES = {}
ORACLE = {}


def _add(key, run, sql=None):
    QUERIES[key] = run
    if sql is not None:
        ORACLE[key] = sql


_add("M01_task_success_rate", _metric("task_success_rate"),
     _flat(_r(f"{_c(DONE)} / nullif(count(*), 0)") + ", count(*) AS ended_tasks", ENDED))
_add("M02_overclaim_rate", _metric("overclaim_rate"),
     _task(_r(f"{_c('contested')} / nullif(count(*), 0)") + ", count(*) AS self_reported_tasks", "self_rep"))
_add("M03_first_run_resolution", _metric("first_run_resolution"),
     _task(_r(f"{_c('runs = 1 AND completed')} / nullif({_c('completed')}, 0)")))
_add("M04_abandonment_rate", _metric("abandonment_rate"),
     _flat(_r(_c("event = 'task_abandoned'") + " / nullif(count(*), 0)"), ENDED))
_add("M05_cost_per_completed_task", _metric("cost_per_completed_task"),
     _flat(_r(f"sum(cost_usd) / nullif({_c(DONE)}, 0)") + ", " + _r("sum(cost_usd)", "total_cost_usd")))
_add("M06_tokens_per_task", _metric("tokens_per_task"),
     _flat(_r("(sum(tokens_in) + sum(tokens_out)) / nullif(count(DISTINCT task_id), 0)"), STEP))
_add("M07_steps_per_task", _metric("steps_per_task"),
     _flat(_r("count(*) / nullif(count(DISTINCT task_id), 0)"), STEP))
_add("M08_latency_p95", _metric("latency_p95"),
     _flat(_r("quantile_cont(latency_ms, 0.95)") + ", " + _r("quantile_cont(latency_ms, 0.5)", "p50"), STEP))
_add("M09_loop_retry_ratio", _metric("loop_retry_ratio"),
     _flat(_r(_c("retry_of_step_id <> ''") + " / nullif(count(*), 0)"), STEP))
_add("M10_per_tool_failure_rate", _metric("per_tool_failure_rate"),
     _flat(_r(_c("status <> 'ok'") + " / nullif(count(*), 0)"), STEP + " AND tool_name <> ''", "tool_name"))
_add("M11_human_edit_distance", _metric("human_edit_distance"),
     _flat(_r("avg(edit_magnitude_value)") + ", count(*) AS edits", "event = 'human_edited'"))
_DELTA = (f"{_c(f'{DONE} AND {AFTER}')} / greatest({_c(AFTER)}, 1)"
          f" - {_c(f'{DONE} AND NOT ({AFTER})')} / greatest({_c(f'NOT ({AFTER})')}, 1)")
_add("M12_regression_delta", _metric("regression_delta", PIVOTED), _flat(_r(_DELTA), ENDED))
_COMPLAINT = _c("event = 'feedback_given' AND rating_value = 0") + f" / greatest({_c(DONE)}, 1)"
_add("M13_complaint_rate", _metric("complaint_rate"), _flat(_r(_COMPLAINT)))
_add("M14_autonomy_rate", _metric("autonomy_rate"),
     _task(_r(_c("NOT touched") + " / nullif(count(*), 0)"), "has_end"))
_add("M15_escalation_rate", _metric("escalation_rate"),
     _flat(_r(_c("event = 'handoff_to_human'") + " / greatest(count(DISTINCT task_id), 1)")))
_add("M16_override_rate", _metric("override_rate"),
     _flat(_r(_c("event = 'human_overrode'") + " / greatest(count(DISTINCT task_id), 1)")))
_add("M17_approval_friction", _metric("approval_friction"),
     _flat(_r("quantile_cont(response_latency_ms, 0.5)") + ", " + _r("quantile_cont(response_latency_ms, 0.95)", "p95"),
           "event = 'human_approved'"))
_add("M18_weekly_task_actors", _metric("weekly_task_actors"),
     oracle(f"SELECT tenant_id, {SUNDAY} AS week, count(DISTINCT session_id) AS value FROM agent_events "
            f"WHERE {IN_WINDOW} AND {START_EV} AND session_id <> '' GROUP BY 1, 2"))
_add("M19_task_depth_expansion", _metric("task_depth_expansion"),
     oracle(f"SELECT tenant_id, {SUNDAY} AS week, count(DISTINCT task_type) AS value FROM agent_events "
            f"WHERE {IN_WINDOW} AND {START_EV} GROUP BY 1, 2"))
_add("M20_delegation_share", _metric("delegation_share"),
     _flat(_r(_c("initiator IN ('agent', 'schedule')") + " / nullif(count(*), 0)"), START_EV))
_add("M21_quality_cohort_retention", _metric("quality_cohort_retention"),
     oracle("SELECT tenant_id, week, CASE WHEN overridden THEN 'overridden' ELSE 'clean' END AS cohort, count(*) AS value "
            "FROM s GROUP BY 1, 2, 3",
            f"s AS (SELECT tenant_id, session_id, {SUNDAY} AS week, bool_or(event = 'human_overrode') AS overridden "
            f"FROM agent_events WHERE {IN_WINDOW} AND session_id <> '' GROUP BY 1, 2, 3)"))
_CUR, _PREV = _c(AFTER), _c(f"NOT ({AFTER})")
_add("M22_net_task_growth", _metric("net_task_growth", PIVOTED),
     _flat(f"{_CUR} AS current, {_PREV} AS previous, " + _r(f"({_CUR} - {_PREV}) / greatest({_PREV}, 1)"), DONE)
     .replace("AS current", 'AS "current"'))


def _m23(spark, sf_dir):
    """One flat and one per-task metric under each allowed segment."""
    args = M.MetricArgs(ALL_TENANTS, START, END, pivot=PIVOT)
    return M.segment_metrics(agent_events(spark, sf_dir), ("task_success_rate", "autonomy_rate"), args).withColumn("value", r6(F.col("value")))


_SEG_SQL = " UNION ALL ".join(
    f"SELECT 'task_success_rate' AS metric, '{s}' AS segment, tenant_id, {s} AS segment_value, "
    f"{_r(f'{_c(DONE)} / nullif(count(*), 0)')} FROM agent_events WHERE {IN_WINDOW} AND {ENDED} GROUP BY tenant_id, {s} "
    f"UNION ALL SELECT 'autonomy_rate', '{s}', tenant_id, sv, {_r(_c('NOT touched') + ' / nullif(count(*), 0)')} FROM ("
    f"SELECT tenant_id, {s} AS sv, task_id, bool_or({TOUCH}) AS touched, bool_or({ENDED}) AS has_end FROM agent_events "
    f"WHERE {IN_WINDOW} GROUP BY 1, 2, 3) WHERE has_end GROUP BY tenant_id, sv" for s in M.SEGMENTS)
_add("M23_segment_by", _m23, oracle(_SEG_SQL))


def _m26(spark, sf_dir):
    return M.metric_panel(agent_events(spark, sf_dir), PIVOTED).withColumn("value", r6(F.col("value")))


_PANEL_FLAT = {
    "task_success_rate": f"{_c(DONE)} / nullif({_c(ENDED)}, 0)",
    "abandonment_rate": _c("event = 'task_abandoned'") + f" / nullif({_c(ENDED)}, 0)",
    "cost_per_completed_task": f"sum(cost_usd) / nullif({_c(DONE)}, 0)",
    "tokens_per_task": f"sum(tokens_in + tokens_out) FILTER (WHERE {STEP}) / nullif(count(DISTINCT task_id) FILTER (WHERE {STEP}), 0)",
    "steps_per_task": f"{_c(STEP)} / nullif(count(DISTINCT task_id) FILTER (WHERE {STEP}), 0)",
    "loop_retry_ratio": _c(STEP + " AND retry_of_step_id <> ''") + f" / nullif({_c(STEP)}, 0)",
    "human_edit_distance": "avg(edit_magnitude_value) FILTER (WHERE event = 'human_edited')",
    "regression_delta": (f"{_c(f'{DONE} AND {AFTER}')} / greatest({_c(f'{ENDED} AND {AFTER}')}, 1)"
                         f" - {_c(f'{DONE} AND NOT ({AFTER})')} / greatest({_c(f'{ENDED} AND NOT ({AFTER})')}, 1)"),
    "complaint_rate": _COMPLAINT,
    "escalation_rate": _c("event = 'handoff_to_human'") + " / greatest(count(DISTINCT task_id), 1)",
    "override_rate": _c("event = 'human_overrode'") + " / greatest(count(DISTINCT task_id), 1)",
    "delegation_share": _c(START_EV + " AND initiator IN ('agent', 'schedule')") + f" / nullif({_c(START_EV)}, 0)",
    "net_task_growth": (f"({_c(f'{DONE} AND {AFTER}')} - {_c(f'{DONE} AND NOT ({AFTER})')})"
                        f" / greatest({_c(f'{DONE} AND NOT ({AFTER})')}, 1)"),
}
_PANEL_TASK = {
    "overclaim_rate": f"{_c('self_rep AND contested')} / nullif({_c('self_rep')}, 0)",
    "first_run_resolution": f"{_c('runs = 1 AND completed')} / nullif({_c('completed')}, 0)",
    "autonomy_rate": f"{_c('has_end AND NOT touched')} / nullif({_c('has_end')}, 0)",
}
PANEL_SQL = " UNION ALL ".join(
    [f"SELECT tenant_id, '{n}' AS metric, {_r(e)} FROM agent_events WHERE {IN_WINDOW} GROUP BY tenant_id"
     for n, e in _PANEL_FLAT.items()]
    + [f"SELECT tenant_id, '{n}' AS metric, {_r(e)} FROM per_task GROUP BY tenant_id" for n, e in _PANEL_TASK.items()])
_add("M26_metric_panel", _m26, oracle(PANEL_SQL, PER_TASK))


def _m27(spark, sf_dir):
    from tallyloom.sources.events import dedupe_events
    ev = agent_events(spark, sf_dir)
    return M.daily_rollup_build(dedupe_events(ev)).withColumn("cost_usd", r6(F.col("cost_usd")))


ROLLUP_SQL = (f"SELECT tenant_id, task_type, CAST(timestamp AS DATE) AS day, {_c(DONE)} AS completed, {_c(ENDED)} AS ended, "
              + _c("event = 'task_abandoned'") + " AS abandoned, CAST(sum(CAST(cost_usd AS DECIMAL(28,12))) AS DOUBLE) AS cost_usd, count(*) AS events "
              "FROM agent_events GROUP BY 1, 2, 3")
_add("M27_daily_rollup_build", _m27,
     oracle("SELECT tenant_id, task_type, day, completed, ended, abandoned, round(cost_usd, 6) AS cost_usd, events FROM r",
            f"r AS ({ROLLUP_SQL})"))


def _m28(spark, sf_dir):
    args = M.MetricArgs(ALL_TENANTS, "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    df = M.daily_rollup_read(M.daily_rollup_build(agent_events(spark, sf_dir)), args)
    return df.select("tenant_id", "day", "completed_tasks", "ended_tasks", "abandoned_tasks",
                     *[r6(F.col(c)).alias(c) for c in ("total_cost_usd", "task_success_rate", "cost_per_completed_task")])


_add("M28_daily_rollup_read", _m28,
     oracle("SELECT tenant_id, day, CAST(sum(completed) AS BIGINT) AS completed_tasks, CAST(sum(ended) AS BIGINT) AS ended_tasks, "
            "CAST(sum(abandoned) AS BIGINT) AS abandoned_tasks, round(CAST(sum(CAST(cost_usd AS DECIMAL(28,12))) AS DOUBLE), 6) AS total_cost_usd, "
            + _r("sum(completed) / greatest(sum(ended), 1)", "task_success_rate") + ", "
            + _r("CAST(sum(CAST(cost_usd AS DECIMAL(28,12))) AS DOUBLE) / greatest(sum(completed), 1)", "cost_per_completed_task")
            + " FROM r WHERE day >= DATE '2024-01-05' AND day <= DATE '2024-01-20' GROUP BY 1, 2", f"r AS ({ROLLUP_SQL})"))

USAGE_SQL = (f"SELECT tenant_id, count(*) AS events_ingested, count(DISTINCT task_id) AS tasks_tracked, "
             f"count(DISTINCT task_id || '|' || run_id) AS agent_runs, count(DISTINCT task_id) FILTER (WHERE {DONE}) AS tasks_completed "
             f"FROM agent_events WHERE {IN_WINDOW} GROUP BY tenant_id")


def usage(spark, sf_dir):
    return BL.usage_meters(agent_events(spark, sf_dir), ARGS)


_add("M29_usage_meter", usage, oracle(USAGE_SQL))
_add("M30_resolve_tier", lambda s, d: BL.resolve_tier(usage(s, d)).select("tenant_id", "agent_runs", "tier", "price_usd_month"),
     oracle("SELECT tenant_id, agent_runs, arg_min(t.name, t.price) AS tier, CAST(min(t.price) AS INTEGER) AS price_usd_month FROM u JOIN t ON "
            "(events_ingested <= e AND tasks_tracked <= k AND agent_runs <= r) OR (t.name = 'growth' AND NOT "
            "(events_ingested <= 10000000 AND tasks_tracked <= 500000 AND agent_runs <= 10000)) GROUP BY 1, 2",
            f"u AS ({USAGE_SQL})",
            "t(name, price, e, k, r) AS (VALUES ('free', 0, 50000, 10000, 500), ('starter', 200, 1000000, 50000, 1000), "
            "('growth', 800, 10000000, 500000, 10000))"))


def _m31(spark, sf_dir):
    """Accounts come from all customers: tenant = twice the nation number, so odd tenants have none; tier by market segment."""
    cust = table(spark, sf_dir, "customer")
    accounts = (cust.groupBy(F.concat(F.lit("t_"), (F.col("c_nationkey") * 2).cast("string")).alias("tenant_id"))
                .agg(F.min("c_mktsegment").alias("seg"), F.count(F.lit(1)).alias("n"))
                .select("tenant_id", F.when(F.col("n") % 3 == 0, "starter").when(F.col("n") % 3 == 1, "free").otherwise(F.col("seg")).alias("tier")))
    return BL.plan_status(usage(spark, sf_dir), accounts).select(
        "tenant_id", "tier", "price_usd_month", "limit_events_ingested", "limit_tasks_tracked", "limit_agent_runs", "over_limit")


_add("M31_plan_status", _m31, oracle(
    "SELECT u.tenant_id, t.name AS tier, t.price AS price_usd_month, CAST(t.e AS BIGINT) AS limit_events_ingested, "
    "CAST(t.k AS BIGINT) AS limit_tasks_tracked, CAST(t.r AS BIGINT) AS limit_agent_runs, "
    "(events_ingested > t.e OR tasks_tracked > t.k OR agent_runs > t.r) AS over_limit FROM u LEFT JOIN a ON a.tenant_id = u.tenant_id "
    "JOIN t ON t.name = CASE WHEN a.tier IN ('free', 'starter', 'growth') THEN a.tier ELSE 'free' END",
    f"u AS ({USAGE_SQL})",
    "a AS (SELECT 't_' || CAST(c_nationkey * 2 AS STRING) AS tenant_id, CASE WHEN count(*) % 3 = 0 THEN 'starter' WHEN count(*) % 3 = 1 "
    "THEN 'free' ELSE min(c_mktsegment) END AS tier FROM customer GROUP BY c_nationkey)",
    "t(name, price, e, k, r) AS (VALUES ('free', 0, 50000, 10000, 500), ('starter', 200, 1000000, 50000, 1000), "
    "('growth', 800, 10000000, 500000, 10000))"))


def _m32(spark, sf_dir):
    """Priced over the orders of each nation so that the included floor matters at every scale."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    done = o.where(F.col("o_orderstatus") == "F").groupBy(F.concat(F.lit("t_"), F.col("c_nationkey").cast("string")).alias("tenant_id")).agg(
        F.count(F.lit(1)).alias("tasks_completed"))
    return BL.task_invoice(done, included=200)


_add("M32_task_invoice", _m32, (
    "SELECT 't_' || CAST(c_nationkey AS VARCHAR) AS tenant_id, count(*) AS completed_tasks, greatest(0, count(*) - 200) AS billable_tasks, "
    "round(greatest(0, count(*) - 200) * CAST(0.05 AS DOUBLE), 2) AS amount_usd, 'tasks_completed' AS meter "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_nationkey"))


def exposures(ev):
    """Every task is exposed once; the arm follows the task's user number."""
    user = F.split("task_id", "_")[1].cast("int")
    return ev.select(F.col("task_id").alias("subject"), F.when(user % 2 == 0, "control").otherwise("variant").alias("arm")).distinct()


def _m33(spark, sf_dir):
    ev = agent_events(spark, sf_dir)
    return M.per_arm_metrics(ev, exposures(ev), M.ARM_METRICS, ARGS).withColumn("value", r6(F.col("value")))


_ARM = "CASE WHEN CAST(split_part(task_id, '_', 2) AS INTEGER) % 2 = 0 THEN 'control' ELSE 'variant' END"
_add("M33_per_arm_metric", _m33, oracle(" UNION ALL ".join(
    f"SELECT tenant_id, {_ARM} AS arm, '{n}' AS metric, {_r(_PANEL_FLAT[n])} FROM agent_events WHERE {IN_WINDOW} GROUP BY 1, 2"
    for n in M.ARM_METRICS)))


def _m34(spark, sf_dir):
    ev = agent_events(spark, sf_dir)
    contrib = M.metric_panel(ev, PIVOTED).select("metric", "tenant_id", "value")
    optin = ev.where(F.col("tenant_id") != "t_6").select("tenant_id").distinct()
    return B.benchmark(contrib, optin)


_add("M34_benchmark", _m34, oracle(
    "SELECT c.metric, c.tenant_id, n, false AS suppressed, CAST(NULL AS VARCHAR) AS reason, floor(mean * 10000 + 0.5) / 10000 AS mean, "
    "floor(sd * 10000 + 0.5) / 10000 AS stddev, "
    "CAST(greatest(floor((SELECT count(*) FROM c c2 WHERE c2.metric = c.metric AND c2.value < c.value) / n * 100 + 0.5), 1) AS INTEGER) AS own_percentile "
    "FROM c JOIN st ON st.metric = c.metric",
    PER_TASK, f"panel AS ({PANEL_SQL.replace('round(', 'ident(')})".replace("ident(", "(").replace(", 6) AS", ") AS"),
    "c AS (SELECT * FROM panel WHERE tenant_id <> 't_6' AND value IS NOT NULL)",
    "st AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM c GROUP BY metric)"))
