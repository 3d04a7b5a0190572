"""Registered queries: scans, runs, failure clusters, series primitives, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import r6
from tallyloom.operators import findings as A
from tallyloom.operators import metrics as M
from tallyloom.operators import runs as R
from tallyloom.operators import series as P
from tallyloom.plans.fixtures import END, IN_WINDOW, PIVOT, START, agent_events, oracle, table
from tallyloom.plans.metric_queries import ARGS, PANEL_SQL, PER_TASK, PIVOTED
from tallyloom.plans.session import written
from tallyloom.sources import events as S

QUERIES = {}
ORACLE = {}


def _add(key, run, sql=None):
    QUERIES[key] = run
    if sql is not None:
        ORACLE[key] = sql


# ---- scans ---------------------------------------------------------------

def _s1(spark, sf_dir):
    scope = S.Scope("t_3", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return S.scan_events(agent_events(spark, sf_dir), scope).groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("task_id").alias("tasks"))


_add("S01_scan_events", _s1, oracle(
    "SELECT event, count(*) AS n, count(DISTINCT task_id) AS tasks FROM agent_events WHERE tenant_id = 't_3' "
    "AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20' GROUP BY event"))


def redelivered(ev):
    """Every event once, plus a second delivery of every third with a corrected status."""
    first = ev.withColumn("seq", F.lit(1))
    again = ev.where(F.col("event_id") % 3 == 0).withColumn("status", F.concat("status", F.lit("!"))).withColumn("seq", F.lit(2))
    return first.unionByName(again)


def _s2(spark, sf_dir):
    out = S.dedupe_events(redelivered(agent_events(spark, sf_dir)), "seq")
    return out.groupBy("tenant_id", "event", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"), r6(F.sum("latency_ms")).alias("latency"))


_add("S02_dedupe_events", _s2, oracle(
    "SELECT tenant_id, event, CASE WHEN event_id % 3 = 0 THEN status || '!' ELSE status END AS status, count(*) AS n, "
    "CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS seqs, round(sum(latency_ms), 6) AS latency "
    "FROM agent_events GROUP BY 1, 2, 3"))


def _s7(spark, sf_dir):
    ev = agent_events(spark, sf_dir).withColumn(
        "residency", F.when(F.col("agent_name") == "agent_0", "eu").when(F.col("agent_name") == "agent_1", "ap"))
    return S.route_by_residency(ev).groupBy("store", "agent_name").agg(F.count(F.lit(1)).alias("n"))


_add("S07_route_by_residency", _s7, oracle(
    "SELECT CASE WHEN agent_name = 'agent_0' THEN 'eu' ELSE 'us' END AS store, agent_name, count(*) AS n FROM agent_events GROUP BY 1, 2"))

# ---- runs ----------------------------------------------------------------


def _r1(spark, sf_dir):
    return R.run_events(agent_events(spark, sf_dir), "t_3", "task_139_12", "run_2").select(
        "timestamp", "event_id", "event", "tool_name", "status")


_add("R1_run_events", _r1, oracle(
    "SELECT timestamp, event_id, event, tool_name, status FROM agent_events WHERE tenant_id = 't_3' AND task_id = 'task_139_12' AND run_id = 'run_2'"))


def _r2(spark, sf_dir):
    return R.reconstruct_runs(agent_events(spark, sf_dir)).select(
        "tenant_id", "task_id", "run_id", "task_type", "session_id", "outcome", F.concat_ws(",", "agents").alias("agents"),
        "steps", "errors", "retries", r6(F.col("tokens")).alias("tokens"), r6(F.col("cost_usd")).alias("cost_usd"), "human_events")


_STEP = "event = 'step_executed'"
_HUMAN = "event IN ('handoff_to_human', 'human_approved', 'human_edited', 'human_overrode')"
_END = "event IN ('task_completed', 'task_failed', 'task_abandoned')"
RUNS_CTE = f"""runs AS (SELECT tenant_id, task_id, run_id, first(task_type ORDER BY timestamp, event_id) AS task_type,
  first(session_id ORDER BY timestamp, event_id) FILTER (WHERE session_id <> '') AS session_id,
  coalesce(replace(last(event ORDER BY timestamp, event_id) FILTER (WHERE {_END}), 'task_', ''), 'in_flight') AS outcome,
  count(*) FILTER (WHERE {_STEP}) AS steps, count(*) FILTER (WHERE {_STEP} AND status <> '' AND status <> 'ok') AS errors,
  count(*) FILTER (WHERE {_STEP} AND retry_of_step_id <> '') AS retries,
  round(coalesce(sum(tokens_in + tokens_out) FILTER (WHERE {_STEP}), 0), 6) AS tokens, round(sum(cost_usd), 6) AS cost_usd,
  count(*) FILTER (WHERE {_HUMAN}) AS human_events,
  bool_or(event IN ('handoff_to_human', 'human_edited', 'human_overrode')) AS intervened
  FROM agent_events GROUP BY 1, 2, 3)"""
_add("R2_reconstruct_runs", _r2, oracle(
    "SELECT r.tenant_id, r.task_id, r.run_id, task_type, session_id, outcome, agents, steps, errors, retries, tokens, cost_usd, human_events FROM runs r JOIN "
    "(SELECT tenant_id, task_id, run_id, string_agg(agent_name, ',' ORDER BY f, e) AS agents FROM (SELECT tenant_id, task_id, run_id, agent_name, "
    "min(timestamp) AS f, min(event_id) AS e FROM agent_events GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) a "
    "ON a.tenant_id = r.tenant_id AND a.task_id = r.task_id AND a.run_id = r.run_id", RUNS_CTE))


def _r3(spark, sf_dir):
    return R.trajectories(agent_events(spark, sf_dir)).select(
        "tenant_id", "task_id", "run_id", F.col("pos").cast("long").alias("pos"), "event", "tool_name", "status", "retry_of_step_id", "completed")


_DETAIL = ("agent_name", "tool_name", "model", "status", "latency_ms", "tokens_in", "tokens_out", "cost_usd", "retry_of_step_id")


def _r2_steps(spark, sf_dir):
    return R.run_steps(agent_events(spark, sf_dir)).select(
        "tenant_id", "task_id", "run_id", "kind", F.col("pos").cast("long").alias("pos"), "event", "timestamp", *_DETAIL)


_add("R2_run_steps", _r2_steps, oracle(
    f"SELECT tenant_id, task_id, run_id, kind, row_number() OVER (PARTITION BY tenant_id, task_id, run_id, kind ORDER BY timestamp, event_id) AS pos, event, timestamp, "
    + ", ".join(f"CASE WHEN kind = 'step' THEN {c} END AS {c}" for c in _DETAIL)
    + f" FROM (SELECT *, CASE WHEN {_STEP} THEN 'step' ELSE 'human' END AS kind FROM agent_events WHERE {_STEP} OR {_HUMAN})"))
_add("R3_trajectories", _r3, oracle(
    "SELECT e.tenant_id, e.task_id, e.run_id, row_number() OVER (PARTITION BY e.tenant_id, e.task_id, e.run_id ORDER BY timestamp, event_id) AS pos, event, "
    "nullif(tool_name, '') AS tool_name, nullif(status, '') AS status, nullif(retry_of_step_id, '') AS retry_of_step_id, "
    "outcome = 'completed' AS completed FROM agent_events e JOIN runs r ON r.tenant_id = e.tenant_id AND r.task_id = e.task_id AND r.run_id = e.run_id", RUNS_CTE))


def _r4(spark, sf_dir):
    return R.waterfall(agent_events(spark, sf_dir)).select(
        "tenant_id", "task_id", "run_id", F.col("pos").cast("long").alias("pos"), "kind", "label", "detail", r6(F.col("share")).alias("share"), "highlight")


_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_add("R4_waterfall", _r4, oracle(
    f"""SELECT e.tenant_id, e.task_id, e.run_id, row_number() OVER (PARTITION BY e.tenant_id, e.task_id, e.run_id ORDER BY timestamp, event_id) AS pos,
  CASE WHEN {_STEP} THEN 'step' ELSE 'human' END AS kind,
  CASE WHEN NOT {_STEP} THEN event WHEN tool_name <> '' THEN tool_name WHEN model <> '' THEN model ELSE 'step' END AS label,
  CASE WHEN {_STEP} THEN concat_ws(' · ', CASE WHEN model <> '' AND tool_name <> '' THEN model END,
    CASE WHEN latency_ms <> 0 THEN {_NUM.format('latency_ms')} || 'ms' END,
    CASE WHEN tokens_in + tokens_out > 0 THEN {_NUM.format('(tokens_in + tokens_out)')} || ' tok' END,
    CASE WHEN status <> '' AND status <> 'ok' THEN status END) ELSE '' END AS detail,
  CASE WHEN {_STEP} THEN round(latency_ms / greatest(1.0, slowest), 6) ELSE 0.0 END AS share,
  CASE WHEN NOT {_STEP} THEN 'human' WHEN status <> '' AND status <> 'ok' THEN 'error' WHEN retry_of_step_id <> '' THEN 'retry' ELSE 'none' END AS highlight
FROM agent_events e LEFT JOIN (SELECT tenant_id, task_id, run_id, max(latency_ms) AS slowest FROM agent_events WHERE {_STEP} GROUP BY 1, 2, 3) m
  ON m.tenant_id = e.tenant_id AND m.task_id = e.task_id AND m.run_id = e.run_id WHERE {_STEP} OR {_HUMAN}""")
    .replace("ELSE 0.0 END AS share", "ELSE CAST(0 AS DOUBLE) END AS share"))


def _failures(spark, sf_dir):
    return R.failure_rows(agent_events(spark, sf_dir), ARGS.scope)


FAIL_CTE = (f"f AS (SELECT * FROM agent_events WHERE {IN_WINDOW} AND ((event = 'step_executed' AND status <> 'ok' AND tool_name <> '') OR event = 'human_overrode'))")
CLUSTER_CTE = """c AS (SELECT tenant_id, CASE WHEN event = 'human_overrode' THEN '{"kind":"human_override","task_type":"' || task_type || '"}'
  ELSE '{"kind":"tool_failure","tool_name":"' || tool_name || '","status":"' || status || '","task_type":"' || task_type || '"}' END AS sig,
  CASE WHEN event = 'human_overrode' THEN 'human overrides on ' || task_type ELSE tool_name || ' ' || status || ' on ' || task_type END AS label,
  CASE WHEN event = 'human_overrode' THEN 'human_override' ELSE 'tool_failure' END AS kind FROM f)"""
_add("R5_failure_rows", lambda s, d: _failures(s, d).drop("timestamp"), oracle(
    "SELECT tenant_id, event, task_type, tool_name, status, task_id, run_id, event_id FROM f", FAIL_CTE))
_add("R6_cluster_failures", lambda s, d: R.cluster_failures(_failures(s, d)).select("tenant_id", "cluster_id", "kind", "label", "member_count"),
     oracle("SELECT tenant_id, 'fc_' || substr(sha256(sig), 1, 12) AS cluster_id, kind, label, count(*) AS member_count FROM c GROUP BY tenant_id, sig, kind, label",
            FAIL_CTE, CLUSTER_CTE))


def _r7(spark, sf_dir):
    out = R.cluster_findings(R.cluster_failures(_failures(spark, sf_dir)), M.query_id("per_tool_failure_rate", ARGS))
    m = F.col("metrics")[0]
    return out.select("tenant_id", "cluster_id", "layer", "severity", "headline", m["value"].alias("metric_value"), m["query_id"].alias("query_id"))


_add("R7_cluster_findings", _r7, oracle(
    "SELECT tenant_id, 'fc_' || substr(sha256(sig), 1, 12) AS cluster_id, CASE WHEN kind = 'human_override' THEN 'A' ELSE 'O' END AS layer, "
    "CASE WHEN count(*) >= 10 THEN 'critical' ELSE 'warning' END AS severity, 'Repeated failure: ' || label || ', seen in ' || count(*) || ' runs.' AS headline, "
    f"CAST(count(*) AS VARCHAR) AS metric_value, '{M.query_id('per_tool_failure_rate', ARGS)}' AS query_id FROM c GROUP BY tenant_id, sig, kind, label",
    FAIL_CTE, CLUSTER_CTE))

# ---- series --------------------------------------------------------------


def daily(spark, sf_dir, by="event_type"):
    """Daily sum of value per event type."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(by, F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))


def gappy(df):
    """A gap on every seventh day of the month."""
    return df.withColumn("v", F.when(F.dayofmonth("day") % 7 != 0, F.col("v")))


DAILY = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"
GAPPY = "g AS (SELECT event_type, day, CASE WHEN day(day) % 7 <> 0 THEN v END AS v FROM d)"
HIST = ("h AS (SELECT g.event_type, g.day, any_value(g.v) AS v, count(p.v) AS n, avg(p.v) AS mu, stddev_pop(p.v) AS sd, "
        "quantile_cont(p.v, 0.5) AS med, quantile_cont(p.v, 0.25) AS q1, quantile_cont(p.v, 0.75) AS q3 "
        "FROM g LEFT JOIN g p ON p.event_type = g.event_type AND p.day < g.day GROUP BY 1, 2)")


def _out(df, *extra):
    return df.select("event_type", "day", "v", "insufficient", r6(F.col("score")).alias("score"), "anomalous",
                     *[r6(F.col(c)).alias(c) for c in extra])


def _verdict_sql(score, extra, anomalous):
    cols = ", ".join(f"CASE WHEN v IS NOT NULL AND n >= 5 THEN round({e}, 6) END AS {a}" for a, e in extra)
    return (f"SELECT event_type, day, v, CASE WHEN v IS NOT NULL THEN n < 5 END AS insufficient, "
            f"CASE WHEN v IS NULL THEN NULL WHEN n < 5 THEN CAST(0 AS DOUBLE) ELSE round({score}, 6) END AS score, "
            f"CASE WHEN v IS NULL THEN NULL WHEN n < 5 THEN false ELSE {anomalous} END AS anomalous, {cols} FROM ")


def _plain(sql):
    return "WITH " + sql


_Z = "abs(v - mu) / nullif(sd, 0)"
_add("P1_anomaly_zscore", lambda s, d: _out(P.anomaly_zscore(gappy(daily(s, d)), ["event_type"], "day", "v", 1.5), "mean", "std_dev"),
     _plain(f"{DAILY}, {GAPPY}, {HIST} " + _verdict_sql(_Z, [("mean", "mu"), ("std_dev", "sd")], f"{_Z} > 1.5") + "h"))
_MAD = "0.6745 * abs(v - med) / nullif(mad, 0)"
_add("P2_anomaly_mad", lambda s, d: _out(P.anomaly_mad(gappy(daily(s, d)), ["event_type"], "day", "v", 1.5), "median", "mad"),
     _plain(f"{DAILY}, {GAPPY}, {HIST}, m AS (SELECT h.event_type, h.day, any_value(h.v) AS v, any_value(n) AS n, any_value(med) AS med, "
            "quantile_cont(abs(p.v - med), 0.5) AS mad FROM h LEFT JOIN g p ON p.event_type = h.event_type AND p.day < h.day GROUP BY 1, 2) "
            + _verdict_sql(_MAD, [("median", "med"), ("mad", "mad")], f"{_MAD} > 1.5") + "m"))
_DIST = "greatest(v - (q3 + 0.5 * (q3 - q1)), (q1 - 0.5 * (q3 - q1)) - v, 0) / nullif(q3 - q1, 0)"
_add("P3_anomaly_iqr", lambda s, d: _out(P.anomaly_iqr(gappy(daily(s, d)), ["event_type"], "day", "v", 0.5), "q1", "q3"),
     _plain(f"{DAILY}, {GAPPY}, {HIST} " + _verdict_sql(_DIST, [("q1", "q1"), ("q3", "q3")], f"{_DIST} > 0") + "h"))


def _p4(spark, sf_dir):
    """Level shift injected per type: the values rise by a third from a type-specific day."""
    d = daily(spark, sf_dir).withColumn("v", F.when(F.dayofmonth("day") >= F.length("event_type") * 2, F.col("v") * 4 / 3).otherwise(F.col("v")))
    return P.changepoint(d, ["event_type"], "day", "v", 0.5).select(
        "event_type", "day", "index", r6(F.col("magnitude")).alias("magnitude"), r6(F.col("significance")).alias("significance"))


_add("P4_changepoint", _p4, _plain(
    DAILY + ", x AS (SELECT event_type, day, CASE WHEN day(day) >= length(event_type) * 2 THEN v * 4 / 3 ELSE v END AS v FROM d), "
    "sp AS (SELECT a.event_type, a.day, count(*) FILTER (WHERE b.day < a.day) AS idx, count(*) FILTER (WHERE b.day >= a.day) AS na, "
    "avg(b.v) FILTER (WHERE b.day >= a.day) - avg(b.v) FILTER (WHERE b.day < a.day) AS mag, "
    "sqrt(var_pop(b.v) FILTER (WHERE b.day < a.day) / nullif(count(*) FILTER (WHERE b.day < a.day), 0) "
    "+ var_pop(b.v) FILTER (WHERE b.day >= a.day) / count(*) FILTER (WHERE b.day >= a.day)) AS se "
    "FROM x a JOIN x b ON a.event_type = b.event_type GROUP BY 1, 2), "
    "ok AS (SELECT *, abs(mag) / se AS sig, row_number() OVER (PARTITION BY event_type ORDER BY abs(mag) / se DESC, idx) AS rn FROM sp "
    "WHERE idx >= 3 AND na >= 3 AND abs(mag) / se >= 0.5) "
    'SELECT event_type, day, idx AS "index", round(mag, 6) AS magnitude, round(sig, 6) AS significance FROM ok WHERE rn = 1'))


def _p5(spark, sf_dir):
    ev = agent_events(spark, sf_dir)
    half = F.col("timestamp") < F.lit(PIVOT).cast("timestamp_ntz")
    seg = ev.groupBy("tenant_id", "task_type").agg(F.count_if(half).alias("before"), F.count_if(~half).alias("after"))
    return P.segment_contributions(seg, ["tenant_id"], "task_type", "before", "after").select(
        "tenant_id", "task_type", "delta", r6(F.col("share")).alias("share"), F.col("rank").cast("long").alias("rank"))


_add("P5_segment_contributions", _p5, oracle(
    "SELECT tenant_id, task_type, delta, coalesce(round(CAST(abs(delta) / nullif(sum(abs(delta)) OVER (PARTITION BY tenant_id), 0) AS DOUBLE), 6), CAST(0 AS DOUBLE)) AS share, "
    "row_number() OVER (PARTITION BY tenant_id ORDER BY abs(delta) DESC, task_type) AS rank FROM (SELECT tenant_id, task_type, "
    f"count(*) FILTER (WHERE timestamp >= TIMESTAMP '{PIVOT}') - count(*) FILTER (WHERE timestamp < TIMESTAMP '{PIVOT}') AS delta FROM agent_events GROUP BY 1, 2)"))


def _p6(spark, sf_dir):
    """Daily value of each other event type against purchases, within user parity groups."""
    ev = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 2)
    d = gappy(ev.groupBy("grp", "event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")))
    target = d.where(F.col("event_type") == "purchase")
    cand = d.where(F.col("event_type") != "purchase").withColumnRenamed("event_type", "candidate")
    return P.rank_correlations(target, cand, ["grp"], "day", "v").select(
        "grp", "candidate", r6(F.col("coefficient")).alias("coefficient"), "n", F.col("rank").cast("long").alias("rank"))


_add("P6_rank_correlations", _p6,
     "WITH d AS (SELECT user_id % 2 AS grp, event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2, 3), "
     "g AS (SELECT * FROM d WHERE day(day) % 7 <> 0), "
     "c AS (SELECT a.grp, b.event_type AS candidate, corr(a.v, b.v) AS r, count(*) AS n FROM g a JOIN g b ON a.grp = b.grp AND a.day = b.day "
     "WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase' GROUP BY 1, 2) "
     "SELECT grp, candidate, round(r, 6) AS coefficient, n, row_number() OVER (PARTITION BY grp ORDER BY abs(r) DESC, candidate) AS rank FROM c WHERE n >= 3")

# ---- findings ------------------------------------------------------------


def _tenants(spark, sf_dir):
    """Tenants of the events and one more per nation, which has no events."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("t_"), F.col("n_nationkey").cast("string")).alias("tenant_id"))
    return nations.unionByName(agent_events(spark, sf_dir).select("tenant_id")).distinct()


def _a1(spark, sf_dir):
    return A.regression_sweep(_tenants(spark, sf_dir), agent_events(spark, sf_dir), PIVOTED, threshold=0.02).select(
        "tenant_id", "status", F.size("checked").alias("n_checked"), "severity", "task_success_rate", "regression_delta", "worst_tool", "worst_tool_failure_rate")


_PTS = "CASE WHEN delta >= 0 THEN '+' ELSE '' END || printf('%.1f pts', delta * 100)"
_add("A1_regression_sweep", _a1, oracle(
    "SELECT t.tenant_id, st AS status, CAST(CASE st WHEN 'no_new_data' THEN 1 WHEN 'no_finding' THEN 2 ELSE 3 END AS INTEGER) AS n_checked, "
    "CASE WHEN st = 'published' THEN CASE WHEN delta < 0 THEN 'critical' ELSE 'positive' END END AS severity, "
    "CASE WHEN st = 'published' THEN printf('%.1f%%', tsr * 100) END AS task_success_rate, "
    f"CASE WHEN st = 'published' THEN {_PTS} END AS regression_delta, "
    "CASE WHEN st = 'published' THEN tool_name END AS worst_tool, CASE WHEN st = 'published' THEN printf('%.1f%%', rate * 100) END AS worst_tool_failure_rate "
    "FROM (SELECT t.tenant_id, tsr, delta, tool_name, rate, CASE WHEN coalesce(ended, 0) = 0 THEN 'no_new_data' WHEN abs(coalesce(delta, 0)) < 0.02 THEN 'no_finding' ELSE 'published' END AS st "
    "FROM tn t LEFT JOIN m ON m.tenant_id = t.tenant_id LEFT JOIN w ON w.tenant_id = t.tenant_id AND w.rn = 1) t",
    "tn AS (SELECT 't_' || CAST(n_nationkey AS VARCHAR) AS tenant_id FROM nation UNION SELECT tenant_id FROM agent_events)",
    f"m AS (SELECT tenant_id, count(*) AS ended, count(*) FILTER (WHERE event = 'task_completed') / count(*) AS tsr, "
    f"count(*) FILTER (WHERE event = 'task_completed' AND timestamp >= TIMESTAMP '{PIVOT}') / greatest(count(*) FILTER (WHERE timestamp >= TIMESTAMP '{PIVOT}'), 1) "
    f"- count(*) FILTER (WHERE event = 'task_completed' AND timestamp < TIMESTAMP '{PIVOT}') / greatest(count(*) FILTER (WHERE timestamp < TIMESTAMP '{PIVOT}'), 1) AS delta "
    f"FROM agent_events WHERE {IN_WINDOW} AND {_END} GROUP BY 1)",
    f"w AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY rate DESC, tool_name) AS rn FROM (SELECT tenant_id, tool_name, count(*) FILTER (WHERE status <> 'ok') / count(*) AS rate "
    f"FROM agent_events WHERE {IN_WINDOW} AND {_STEP} AND tool_name <> '' GROUP BY 1, 2))"))


def _a2(spark, sf_dir):
    return A.weekly_digest(agent_events(spark, sf_dir), ARGS).select("tenant_id", "metric", "label", "text")


_add("A2_weekly_digest", _a2, oracle(
    "SELECT tenant_id, p.metric, l.label, CASE WHEN p.metric = 'cost_per_completed_task' THEN printf('$%.2f', value) ELSE printf('%.1f%%', value * 100) END AS text "
    "FROM panel p JOIN l ON l.metric = p.metric UNION ALL SELECT tenant_id, 'weekly_task_actors', 'Weekly task actors', CAST(arg_max(n, week) AS VARCHAR) FROM "
    "(SELECT tenant_id, CAST(timestamp AS DATE) - CAST(dayofweek(CAST(timestamp AS DATE)) AS INTEGER) AS week, count(DISTINCT session_id) AS n FROM agent_events "
    f"WHERE {IN_WINDOW} AND event = 'task_started' AND session_id <> '' GROUP BY 1, 2) GROUP BY 1",
    PER_TASK, f"panel AS ({PANEL_SQL})",
    "l(metric, label) AS (VALUES ('task_success_rate', 'Task success rate'), ('cost_per_completed_task', 'Cost / completed task'), "
    "('autonomy_rate', 'Autonomy rate'), ('override_rate', 'Override/takeover rate'))"))

_ALERT_SQL = ("al AS (SELECT 'a_' || CAST(n_nationkey AS STRING) AS alert_id, 't_' || CAST(n_nationkey % 10 AS STRING) AS tenant_id, n_name AS name, "
              "CASE n_nationkey % 3 WHEN 0 THEN 'task_success_rate' WHEN 1 THEN 'cost_per_completed_task' ELSE 'override_rate' END AS metric, "
              "CASE WHEN n_nationkey % 2 = 0 THEN CAST(0.6 AS DOUBLE) END AS above, CASE WHEN n_nationkey % 2 = 1 THEN CAST(0.35 AS DOUBLE) END AS below FROM nation)")


def _alerts(spark, sf_dir):
    return spark.sql("WITH " + _ALERT_SQL.replace("FROM nation)", "FROM {nation})") + " SELECT * FROM al", nation=table(spark, sf_dir, "nation"))


def _a3(spark, sf_dir):
    panel = M.metric_panel(agent_events(spark, sf_dir), PIVOTED)
    return A.threshold_alerts(panel, _alerts(spark, sf_dir)).withColumn("value", r6(F.col("value")))


_add("A3_threshold_alerts", _a3, oracle(
    "SELECT alert_id, al.tenant_id, al.metric, coalesce(value > above, false) OR coalesce(value < below, false) AS fired, value, "
    "CASE WHEN value IS NULL THEN 'no data in window' WHEN coalesce(value > above, false) OR coalesce(value < below, false) THEN "
    "name || ': ' || al.metric || ' = ' || printf('%.4f', value) || ' (' || CASE WHEN above IS NOT NULL THEN printf('above %.4f', above) ELSE printf('below %.4f', below) END || ')' END AS message "
    "FROM al LEFT JOIN panel p ON p.tenant_id = al.tenant_id AND p.metric = al.metric", PER_TASK, f"panel AS ({PANEL_SQL})", _ALERT_SQL))


def _a4(spark, sf_dir):
    return A.anomaly_alerts(daily(spark, sf_dir), ["event_type"], "day", "v", 1.0).select("event_type", "day", "value", r6(F.col("score")).alias("score"), "fired")


_add("A4_anomaly_alerts", _a4, _plain(
    DAILY + ", s AS (SELECT event_type, day, v, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn "
    "FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT event_type, day, v AS value, round(abs(v - mu) / sd, 6) AS score, abs(v - mu) / sd > 1.0 AS fired FROM s WHERE rn = 1"))


def _scores(spark, sf_dir):
    """Quality labels as scores, one evaluator per source; every third document is scored in the current window."""
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return lab.select(
        F.col("source").alias("evaluator_id"), F.when(F.col("doc_id") % 3 == 0, "current").otherwise("previous").alias("period"),
        F.col("quality").cast("double").alias("value"))


def _a5(spark, sf_dir):
    sc = _scores(spark, sf_dir)
    alerts = sc.select("evaluator_id").distinct().select(
        F.concat(F.lit("al_"), "evaluator_id").alias("alert_id"), "evaluator_id", F.col("evaluator_id").alias("name"), F.lit(0.05).alias("max_drop"))
    return A.eval_regression_alerts(sc, alerts).withColumn("value", r6(F.col("value")))


_add("A5_eval_regression_alerts", _a5,
     "WITH l AS (SELECT d.source, l.doc_id, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id), "
     "m AS (SELECT source, avg(quality) FILTER (WHERE doc_id % 3 = 0) AS cur, avg(quality) FILTER (WHERE doc_id % 3 <> 0) AS prev FROM l GROUP BY source) "
     "SELECT 'al_' || source AS alert_id, source AS evaluator_id, coalesce(prev - cur > 0.05, false) AS fired, "
     "CASE WHEN prev - cur IS NOT NULL THEN round(cur, 6) END AS value, CASE WHEN prev - cur IS NULL THEN 'insufficient eval scores to compare' WHEN prev - cur > 0.05 THEN "
     "source || ': mean score fell by ' || printf('%.3f (%.3f to %.3f)', prev - cur, prev, cur) END AS message FROM m")


def _a6(spark, sf_dir):
    """Three recorded evaluation rounds of the threshold alerts; the newest two per alert."""
    ev = agent_events(spark, sf_dir)
    # the events are folded once; what the rounds differ in is the window
    ev = written(S.fold_copies(S.scan_events(ev, S.Scope(S.ALL_TENANTS, START, END))), "folded")
    rounds = None
    for i, end in enumerate(("2024-01-11 00:00:00", "2024-01-21 00:00:00", END)):
        panel = M.metric_panel(ev, M.MetricArgs(S.ALL_TENANTS, START, end), [n for n in M.PANEL if not M.METRICS[n].needs_pivot], deduped=True)
        part = A.threshold_alerts(panel, _alerts(spark, sf_dir)).withColumn("evaluated_at", F.lit(i))
        rounds = part if rounds is None else rounds.unionByName(part)
    return A.alert_history(rounds, 2).select("alert_id", "evaluated_at", "fired", r6(F.col("value")).alias("value"))


def _a6_sql():
    parts, ctes = [], [_ALERT_SQL]
    for i, end in ((1, "2024-01-21 00:00:00"), (2, END)):
        ctes.append(f"p{i} AS (SELECT tenant_id, count(*) FILTER (WHERE event = 'task_completed') / nullif(count(*) FILTER (WHERE {_END}), 0) AS tsr, "
                    f"sum(cost_usd) / nullif(count(*) FILTER (WHERE event = 'task_completed'), 0) AS cpct, "
                    f"count(*) FILTER (WHERE event = 'human_overrode') / greatest(count(DISTINCT task_id), 1) AS ovr FROM agent_events "
                    f"WHERE timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{end}' GROUP BY 1)")
        v = "CASE metric WHEN 'task_success_rate' THEN tsr WHEN 'cost_per_completed_task' THEN cpct ELSE ovr END"
        parts.append(f"SELECT alert_id, {i} AS evaluated_at, coalesce({v} > above, false) OR coalesce({v} < below, false) AS fired, round({v}, 6) AS value "
                     f"FROM al LEFT JOIN p{i} ON p{i}.tenant_id = al.tenant_id")
    return oracle(" UNION ALL ".join(parts), *ctes)


_add("A6_alert_events", _a6, _a6_sql())
