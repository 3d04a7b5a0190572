"""Registered queries: sinks, lifecycle, operations tables, streaming jobs.

The streaming queries run over the events file with the availableNow trigger
and return the table they wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import r6
from tallyloom.operators import cohorts as C
from tallyloom.operators import lifecycle as L
from tallyloom.operators import metrics as M
from tallyloom.operators import ops as O
from tallyloom.plans.fixtures import IN_WINDOW, agent_events, oracle, table
from tallyloom.plans.ingest_queries import CLASS, messages, payloads, settings
from tallyloom.plans.metric_queries import ARGS, ROLLUP_SQL
from tallyloom.plans.product_queries import STEPS
from tallyloom.plans.run_queries import redelivered
from tallyloom.plans.session import fresh_dir
from tallyloom.sources import citations
from tallyloom.sources import events as S
from tallyloom.streaming import jobs as J
from tallyloom.streaming import sink as K

QUERIES = {}
ORACLE = {}


def _add(key, run, sql=None):
    QUERIES[key] = run
    if sql is not None:
        ORACLE[key] = sql


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return J.event_stream(spark, sf_dir, schema, "parquet", pathGlobFilter="events.parquet")


def _stream_of(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


# ---- sinks ---------------------------------------------------------------

def _s3(spark, sf_dir):
    out = fresh_dir(spark, "s3")
    K.run_to_table(events_stream(spark, sf_dir), f"{out}/t", f"{out}/cp")
    return K.read_batches(spark, f"{out}/t").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


_add("S03_event_stream", _s3, "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")


def _s6(spark, sf_dir):
    """The first 60% of the days as one batch, written twice and once more under another id; then everything under a new id."""
    ev = agent_events(spark, sf_dir)
    out = fresh_dir(spark, "s6")
    first = ev.where(F.dayofmonth("timestamp") <= 18)
    for _ in range(2):
        J.write_events_idempotent(spark, first, out, 0)
    J.write_events_idempotent(spark, first.orderBy("event_id"), out, 7)
    J.write_events_idempotent(spark, ev, out, 1)
    t = K.read_batches(spark, out)
    return t.groupBy("tenant_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


_add("S06_write_events_idempotent", _s6, oracle(
    "SELECT tenant_id, CAST(CASE WHEN day(timestamp) <= 18 THEN 0 ELSE 1 END AS INTEGER) AS batch_id, count(*) AS n, count(DISTINCT event_id) AS ids FROM agent_events GROUP BY 1, 2"))


def _s9(spark, sf_dir):
    """All metrics without a pivot are cited at once, in one file; one of them is resolved."""
    path = fresh_dir(spark, "s9")
    names = [n for n, m in M.METRICS.items() if not m.needs_pivot]
    qid = dict(zip(names, citations.log_citations(spark, path, [(n, ARGS) for n in names])))["task_success_rate"]
    cited = citations.resolve_citation(spark, path, qid).select("query_id", "metric", "layer")
    rows = M.metric("task_success_rate", agent_events(spark, sf_dir), ARGS).withColumn("query_id", F.lit(qid))
    return rows.join(cited, "query_id").select("tenant_id", "query_id", "metric", "layer", r6(F.col("value")).alias("value"))


_add("S09_citations", _s9, oracle(
    f"SELECT tenant_id, '{M.query_id('task_success_rate', ARGS)}' AS query_id, 'task_success_rate' AS metric, 'T' AS layer, "
    f"round(count(*) FILTER (WHERE event = 'task_completed') / count(*), 6) AS value FROM agent_events WHERE {IN_WINDOW} AND event IN ('task_completed', 'task_failed', 'task_abandoned') GROUP BY 1"))


def _s10(spark, sf_dir):
    path = fresh_dir(spark, "s10")
    S.write_event_table(agent_events(spark, sf_dir), path)
    t = S.scan_events(S.read_event_table(spark, path), S.Scope(S.ALL_TENANTS, "2024-01-03 00:00:00", "2024-01-25 00:00:00"))
    return t.groupBy("month", "tenant_id", "event").agg(F.count(F.lit(1)).alias("n")).withColumn("month", F.col("month").cast("string"))


_add("S10_write_event_table", _s10, oracle(
    "SELECT strftime(timestamp, '%Y-%m') AS month, tenant_id, event, count(*) AS n FROM agent_events WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-25' GROUP BY 1, 2, 3"))

# ---- lifecycle -----------------------------------------------------------

NOW = "2024-02-01 00:00:00"
_add("L1_expire_events", lambda s, d: L.expire_events(agent_events(s, d), F.lit(NOW).cast("timestamp_ntz")).groupBy("tenant_id").agg(
    F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest")),
    oracle(f"SELECT tenant_id, count(*) AS n, min(timestamp) AS oldest FROM agent_events WHERE timestamp + to_days(retention_days) > TIMESTAMP '{NOW}' GROUP BY 1"))


def _l2(spark, sf_dir):
    ev = L.erase_tenant(agent_events(spark, sf_dir), "t_5")
    ro = L.erase_tenant(M.daily_rollup_build(agent_events(spark, sf_dir)), "t_5").groupBy("tenant_id").agg(F.sum("events").alias("rollup_events"))
    return ev.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).join(ro, "tenant_id", "full_outer")


_add("L2_erase_tenant", _l2, oracle("SELECT tenant_id, count(*) AS n, count(*) AS rollup_events FROM agent_events WHERE tenant_id <> 't_5' GROUP BY 1"))


def _requests(spark, sf_dir):
    """Erasure requests: the sessions whose user number ends in 7."""
    return agent_events(spark, sf_dir).where(F.col("session_id").endswith("7")).select("tenant_id", "session_id").distinct()


def _l3(spark, sf_dir):
    ev = agent_events(spark, sf_dir)
    req = _requests(spark, sf_dir)
    return L.erase_end_users_from_rollup(M.daily_rollup_build(ev), ev, req).withColumn("cost_usd", r6(F.col("cost_usd")))


_add("L3_erase_end_user", _l3, oracle(
    "SELECT tenant_id, task_type, day, completed, ended, abandoned, round(cost_usd, 6) AS cost_usd, events FROM r",
    f"r AS ({ROLLUP_SQL.replace('FROM agent_events', 'FROM agent_events WHERE session_id NOT LIKE ' + chr(39) + '%7' + chr(39))})"))


def _l4(spark, sf_dir):
    """A table with redelivered rows, compacted month by month; the newest copy stays."""
    path = fresh_dir(spark, "l4")
    S.write_event_table(redelivered(agent_events(spark, sf_dir)), path)
    L.compact_events(spark, path, ["2024-01"], "seq")
    return S.read_event_table(spark, path).groupBy("tenant_id", "event", "seq").agg(F.count(F.lit(1)).alias("n"))


_add("L4_compact_events", _l4, oracle(
    "SELECT tenant_id, event, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS seq, count(*) AS n FROM agent_events GROUP BY 1, 2, 3"))


def _l3_in_place(spark, sf_dir):
    """The same requests on a written table: its months are rewritten in place; then one tenant is erased and what is old expires."""
    path = fresh_dir(spark, "l3")
    S.write_event_table(agent_events(spark, sf_dir), path)
    L.rewrite_table(spark, path, ~F.col("session_id").endswith("7"))
    L.rewrite_table(spark, path, F.col("tenant_id") != "t_5")
    L.rewrite_table(spark, path, L.alive(F.lit(NOW).cast("timestamp_ntz")))
    return S.read_event_table(spark, path).groupBy("tenant_id", "event").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"))


_add("L3_erase_in_place", _l3_in_place, oracle(
    f"SELECT tenant_id, event, count(*) AS n, min(timestamp) AS oldest FROM agent_events WHERE session_id NOT LIKE '%7' AND tenant_id <> 't_5' AND timestamp + to_days(retention_days) > TIMESTAMP '{NOW}' GROUP BY 1, 2"))


def _l5(spark, sf_dir):
    """A rollup that lacks one tenant's tenth day and double counts another's: the two differences."""
    ev = agent_events(spark, sf_dir)
    ro = M.daily_rollup_build(ev)
    bad = ro.where(~((F.col("tenant_id") == "t_1") & (F.dayofmonth("day") == 10))).withColumn(
        "events", F.when((F.col("tenant_id") == "t_2") & (F.dayofmonth("day") == 11), F.col("events") * 2).otherwise(F.col("events")))
    return L.reconcile_rollup(bad, ev).select("tenant_id", "task_type", "day", "rollup_events", "raw_events")


_add("L5_reconcile_rollup", _l5, oracle(
    "SELECT tenant_id, task_type, day, CASE WHEN tenant_id = 't_2' THEN events * 2 END AS rollup_events, events AS raw_events FROM r "
    "WHERE (tenant_id = 't_1' AND day(day) = 10) OR (tenant_id = 't_2' AND day(day) = 11)", f"r AS ({ROLLUP_SQL})"))

# ---- operations tables, from orders and customers ------------------------


def _instrument_runs(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.when((s == "F") & (F.col("o_custkey") % 4 == 0), "edited_then_merged").when(s == "F", "merged").when(s == "O", "closed").otherwise("open").alias("outcome"))


_add("O1_merge_rate", lambda s, d: O.merge_rate(_instrument_runs(s, d), ["o_orderpriority"]),
     "SELECT o_orderpriority, count(*) AS delivered, count(*) FILTER (WHERE o_orderstatus = 'F') AS merged FROM orders GROUP BY 1")
_add("O2_rejections_by_reason", lambda s, d: O.rejections_by_reason(table(s, d, "orders").select(F.col("o_orderpriority").alias("reason"))),
     'SELECT o_orderpriority AS reason, count(*) AS "count" FROM orders GROUP BY 1')


def _timeline(spark, sf_dir):
    """Milestones per customer, one order after the other: the k-th needs k orders."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"), F.count(F.lit(1)).alias("n"))
    at = lambda k: F.when(F.col("n") >= k, F.col("lo"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("c_"), F.col("c_custkey").cast("string")).alias("tenant_id"), F.col("c_name").alias("name"), at(2).alias("connected_at"), at(5).alias("plan_proposed_at"),
        at(7).alias("plan_approved_at"), at(9).alias("first_event_at"), F.when(F.col("n") >= 11, F.col("hi")).alias("first_finding_at"))


_ST = ("st AS (SELECT 'c_' || c_custkey AS tenant_id, c_name AS name, CASE WHEN n >= 11 THEN 'active' WHEN n >= 9 THEN 'awaiting_first_finding' WHEN n >= 7 THEN 'awaiting_data' WHEN n >= 5 THEN 'review_plan' "
       "WHEN n >= 2 THEN 'awaiting_plan' ELSE 'connect_repo' END AS step, CASE WHEN n >= 11 THEN epoch_ms(hi) - epoch_ms(lo) END AS took FROM customer LEFT JOIN "
       "(SELECT o_custkey, min(o_orderdate) AS lo, max(o_orderdate) AS hi, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)")
_add("O3_onboarding_state", lambda s, d: O.onboarding_state(_timeline(s, d)), f"WITH {_ST} SELECT tenant_id, step AS current_step, took AS time_to_first_finding_ms FROM st")
_add("O4_onboarding_funnel", lambda s, d: O.onboarding_funnel(O.onboarding_state(_timeline(s, d))),
     f"WITH {_ST} SELECT step AS current_step, count(*) AS tenants, (SELECT quantile_cont(took, 0.5) FROM st) AS median_time_to_first_finding_ms FROM st GROUP BY 1")


def _accounts(spark, sf_dir):
    """All customers, tier by market segment; MACHINERY has none recorded."""
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c_"), F.col("c_custkey").cast("string")).alias("tenant_id"), F.when(seg == "BUILDING", "growth").when(seg == "FURNITURE", "starter").when(seg == "HOUSEHOLD", "legacy").when(seg != "MACHINERY", "free").alias("tier"))


_TIER = "CASE c_mktsegment WHEN 'BUILDING' THEN 'growth' WHEN 'FURNITURE' THEN 'starter' WHEN 'HOUSEHOLD' THEN 'legacy' WHEN 'MACHINERY' THEN NULL ELSE 'free' END"
_add("O5_revenue_rollup", lambda s, d: _rounded(O.revenue_rollup(_accounts(s, d), table(s, d, "orders").select(F.col("o_totalprice").alias("amount_usd")))),
     f"SELECT tier, count(*) AS accounts, count(*) * CASE tier WHEN 'growth' THEN 800 WHEN 'starter' THEN 200 ELSE 0 END AS recurring_usd_month, (SELECT round(sum(o_totalprice), 6) FROM orders) AS invoiced_usd_total "
     f"FROM (SELECT {_TIER} AS tier FROM customer) GROUP BY tier")


def _o6(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("tenant_id", F.concat(F.lit("c_"), F.col("o_custkey").cast("string")))
    grants = o.where(F.col("o_orderstatus") == "F").select("tenant_id", F.col("o_orderkey").alias("grant_id"), (F.col("o_orderkey") % 5).cast("int").alias("level"))
    entries = o.select("tenant_id", F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "deprecated").otherwise("proposed").alias("status"))
    t = _timeline(spark, sf_dir)
    return O.tenant_summary(t, O.onboarding_state(t), grants, _accounts(spark, sf_dir), entries)


_add("O6_tenant_summary", _o6,
     f"WITH {_ST}, g AS (SELECT o_custkey AS k, arg_max(o_orderkey % 5, o_orderkey) AS lv FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), "
     f"t AS (SELECT c_custkey AS k, {_TIER} AS tier FROM customer), "
     "e AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS a, count(*) FILTER (WHERE o_orderstatus = 'P') AS d FROM orders GROUP BY 1) "
     "SELECT st.tenant_id, st.name, st.step AS onboarding_step, CAST(coalesce(lv, 0) AS INTEGER) AS autonomy_level, coalesce(tier, 'free') AS tier, coalesce(n, 0) AS entries, coalesce(a, 0) AS active, coalesce(d, 0) AS deprecated "
     "FROM st LEFT JOIN g ON 'c_' || g.k = st.tenant_id LEFT JOIN t ON 'c_' || t.k = st.tenant_id LEFT JOIN e ON 'c_' || e.k = st.tenant_id")
_add("O7_latest", lambda s, d: O.latest(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 3, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).drop("rank"),
     "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")


def _o8(spark, sf_dir):
    """Parts as registry entries of their brand: the local file lacks some and changed others."""
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("tenant_id"), F.concat(F.lit("ev_"), k.cast("string")).alias("event"), F.col("p_type").alias("journey"),
        F.when(k % 4 == 0, "deprecated").otherwise("active").alias("status"), k.alias("k"))
    remote = base.where(F.col("k") % 7 != 0).drop("k")
    local = base.where(F.col("k") % 10 != 0).withColumn("journey", F.when(F.col("k") % 11 == 0, "changed").otherwise(F.col("journey"))).drop("k")
    return O.registry_diff(local, remote, "event", ["tenant_id"])


_add("O8_registry_diff", _o8,
     "SELECT p_brand AS tenant_id, 'ev_' || p_partkey AS event, c AS change FROM (SELECT *, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 10 = 0 AND p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 4 <> 0 THEN 'removed' END "
     "WHEN p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 = 0 THEN 'modified' END AS c FROM part) WHERE c IS NOT NULL")
_add("O9_registry_fingerprint", lambda s, d: O.registry_fingerprint(table(s, d, "part").select("p_brand", "p_name", "p_partkey", "p_type"), ["p_brand"]),
     "WITH h AS (SELECT p_brand, sha256(concat_ws(chr(31), p_name, CAST(p_partkey AS VARCHAR), p_type)) AS h FROM part) "
     "SELECT p_brand, 'fp_' || substr(sha256(count(*) || '|' || " + " || '|' || ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT))" for i in range(4)) + "), 1, 16) AS fingerprint FROM h GROUP BY 1")

# ---- streaming -----------------------------------------------------------


def _x1(spark, sf_dir):
    out = fresh_dir(spark, "x1")
    msgs = messages(spark, sf_dir, events_stream(spark, sf_dir)).select("tenant_id", "payload")
    st = settings(spark, sf_dir)
    K.run_available(msgs, lambda df, i: J.ingest_batch(spark, df, i, st, out), f"{out}/cp")
    rows = K.read_batches(spark, f"{out}/events").groupBy("tenant_id", "store", "event").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.contains("payload", F.lit("[REDACTED:email] or call [REDACTED:phone]"))).alias("redacted"),
        F.max("retention_days").alias("retention_days"))
    rej = K.read_batches(spark, f"{out}/rejections").groupBy("tenant_id", "reason_class").agg(F.sum("rejected").alias("n"))
    return rows.unionByName(rej.select("tenant_id", F.lit("rejected").alias("store"), F.col("reason_class").alias("event"), "n", F.lit(0).cast("long").alias("redacted"), F.lit(0).alias("retention_days")))


_D = "event_id % 20"
_add("X1_ingest_stream", _x1, oracle(
    f"SELECT tenant_id, CASE WHEN tn % 4 = 0 THEN 'eu' ELSE 'us' END AS store, CASE WHEN {_D} = 5 THEN 'checkout_done' ELSE event END AS event, count(*) AS n, "
    f"count(*) FILTER (WHERE {_D} = 9 AND tn <> 4) AS redacted, CAST(max(CASE WHEN tn % 2 = 0 THEN tn * 50 + 30 ELSE 365 END) AS INTEGER) AS retention_days "
    f"FROM (SELECT *, CAST(substr(tenant_id, 3) AS INTEGER) AS tn, {CLASS} AS rc FROM agent_events) WHERE rc IS NULL GROUP BY 1, 2, 3 "
    f"UNION ALL SELECT tenant_id, 'rejected', {CLASS}, count(*), 0, 0 FROM agent_events WHERE {CLASS} IS NOT NULL GROUP BY 1, 3"))


def _x1_spans(spark, sf_dir):
    """Every event as a trace payload through the ingest job, then all of them again under another batch id."""
    out = fresh_dir(spark, "x1s")
    st, made = settings(spark, sf_dir), payloads(spark, sf_dir, events_stream(spark, sf_dir)).select("tenant_id", "payload")
    K.run_available(made, lambda df, i: J.ingest_spans_batch(spark, df, i, st, out), f"{out}/cp")
    J.ingest_spans_batch(spark, payloads(spark, sf_dir).select("tenant_id", "payload"), 99, st, out)
    rows = K.read_batches(spark, f"{out}/events").groupBy("tenant_id", "store", "event").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), r6(F.sum("tokens_in")).alias("tokens_in"), F.max("retention_days").alias("retention_days"))
    bad = K.read_batches(spark, f"{out}/rejections").where("batch_id = 0").groupBy("tenant_id", "reason_class").agg(F.sum("rejected").alias("n"))
    none = F.lit(0).cast("long")
    return rows.unionByName(bad.select("tenant_id", F.lit("rejected").alias("store"), F.col("reason_class").alias("event"), "n", none.alias("ids"), F.lit(0.0).alias("tokens_in"), F.lit(0).alias("retention_days")))


_ENDS = "('task_completed', 'task_failed', 'task_abandoned')"
_SPAN_TENANT = ("CASE WHEN tn % 4 = 0 THEN 'eu' ELSE 'us' END AS store", "CAST(max(CASE WHEN tn % 2 = 0 THEN tn * 50 + 30 ELSE 365 END) AS INTEGER) AS retention_days")
_add("X1_ingest_spans", _x1_spans, oracle(
    f"SELECT tenant_id, {_SPAN_TENANT[0]}, out_event AS event, count(*) AS n, count(*) AS ids, round(sum(CASE WHEN out_event = 'step_executed' THEN tokens_in ELSE 0 END), 6) AS tokens_in, {_SPAN_TENANT[1]} "
    f"FROM (SELECT *, CAST(substr(tenant_id, 3) AS INTEGER) AS tn, unnest(CASE WHEN event IN {_ENDS} THEN ['task_started', event] ELSE [event] END) AS out_event FROM agent_events "
    f"WHERE event = 'step_executed' OR event IN {_ENDS}) GROUP BY 1, 2, 3 "
    f"UNION ALL SELECT tenant_id, 'rejected', 'unmapped_span', count(*), 0, 0.0, 0 FROM agent_events WHERE event <> 'step_executed' AND event NOT IN {_ENDS} GROUP BY 1"))


def _agent_stream(spark, sf_dir):
    return _stream_of(agent_events(spark, sf_dir, events_stream(spark, sf_dir)))


def _x2(spark, sf_dir):
    out = fresh_dir(spark, "x2")
    ev = _agent_stream(spark, sf_dir)
    twice = ev.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    K.run_to_table(J.dedupe_stream(twice), f"{out}/t", f"{out}/cp")
    return K.read_batches(spark, f"{out}/t").groupBy("tenant_id", "event").agg(F.count(F.lit(1)).alias("n"))


_add("X2_dedupe_stream", _x2, oracle("SELECT tenant_id, event, count(*) AS n FROM agent_events GROUP BY 1, 2"))


def _x3(spark, sf_dir):
    out = fresh_dir(spark, "x3")
    K.run_to_table(J.rollup_stream(_agent_stream(spark, sf_dir)), f"{out}/t", f"{out}/cp", "update")
    return K.latest_per_key(K.read_batches(spark, f"{out}/t"), ["tenant_id", "task_type", "day"]).withColumn("cost_usd", r6(F.col("cost_usd")))


_add("X3_rollup_stream", _x3, oracle("SELECT tenant_id, task_type, day, completed, ended, abandoned, round(cost_usd, 6) AS cost_usd, events FROM r", f"r AS ({ROLLUP_SQL})"))


def _timed(df):
    """Event time has to be an instant for a watermark."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _x4(spark, sf_dir):
    """Daily windows per event type with the baselines carried along; the last open day is not emitted."""
    out = fresh_dir(spark, "x4")
    closed = J.closed_readings_stream(_timed(events_stream(spark, sf_dir)), "event_type", "ts", "value", "1 day", "1 day")
    K.run_available(closed, lambda df, i: J.baseline_batch(spark, J.window_metrics(df, "event_type"), i, "event_type", out), f"{out}/cp")
    b = K.read_batches(spark, f"{out}/baselines")
    return _rounded(b.select("event_type", F.to_date("at").alias("day"), "min", "max", "value", "count", "p50", "p90", "points", "std_dev"))


_add("X4_rolling_metrics_stream", _x4,
     "WITH w AS (SELECT event_type, CAST(ts AS DATE) AS day, min(value) AS mn, max(value) AS mx, avg(value) AS v, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1, 2), "
     "b AS (SELECT *, count(*) OVER o AS points, avg(v) OVER o AS mean FROM w WINDOW o AS (PARTITION BY event_type ORDER BY day)), "
     "c AS (SELECT *, sqrt(sum((v - mean) * (v - mean)) OVER (PARTITION BY event_type ORDER BY day) / points) AS sd FROM b) "
     'SELECT event_type, day, round(mn, 6) AS "min", round(mx, 6) AS "max", round(v, 6) AS value, n AS "count", round(p50, 6) AS p50, round(p90, 6) AS p90, points, round(sd, 6) AS std_dev FROM c '
     "WHERE day < (SELECT max(CAST(ts AS DATE)) FROM events)")


def _x5(spark, sf_dir):
    out = fresh_dir(spark, "x5")
    K.run_to_table(J.funnel_stream(_timed(events_stream(spark, sf_dir)), STEPS), f"{out}/t", f"{out}/cp", "update")
    return J.funnel_latest(K.read_latest(spark, f"{out}/t", ["user_id", "step_id", "day"])).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_add("X5_funnel_stream", _x5,
     f"SELECT user_id, event_type AS step_id, max(ts) AS last_at, count(*) AS hits FROM events WHERE event_type = 'view' OR (event_type = 'signup' AND {_K} > 85) OR (event_type = 'purchase' AND {_K} > 90) GROUP BY 1, 2")


def _x6(spark, sf_dir):
    out = fresh_dir(spark, "x6")
    cohort = C.cohort_users(table(spark, sf_dir, "events"), "day")
    K.run_to_table(J.cohort_stream(_timed(events_stream(spark, sf_dir)), cohort), f"{out}/t", f"{out}/cp", "update")
    return _rounded(C.whole_periods(K.read_latest(spark, f"{out}/t", ["user_id", "cohort", "period", "day"])))


_add("X6_cohort_stream", _x6,
     "WITH co AS (SELECT user_id, min(ts) AS c0, strftime(min(ts), '%Y-%m-%d') AS cohort FROM events GROUP BY 1), "
     "a AS (SELECT e.user_id, cohort, CAST(floor(date_diff('microsecond', c0, ts) / 604800000000) AS INTEGER) AS period, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS r FROM events e JOIN co ON co.user_id = e.user_id GROUP BY 1, 2, 3) "
     "SELECT user_id, cohort, period, n AS events, round(r, 6) AS revenue, round(CAST(least(1.0, least(1.0, n / 10.0) + CASE WHEN r > 0 THEN 0.2 ELSE 0 END) AS DOUBLE), 6) AS engagement FROM a")


def _x7(spark, sf_dir):
    """Every ninth event arrives after its rollup was built."""
    ev = agent_events(spark, sf_dir)
    late = ev.where(F.col("event_id") % 9 == 0)
    stale = M.daily_rollup_build(ev.where(F.col("event_id") % 9 != 0))
    return L.repair_late_days(stale, ev, late).withColumn("cost_usd", r6(F.col("cost_usd")))


_add("X7_repair_late_days", _x7, oracle("SELECT tenant_id, task_type, day, completed, ended, abandoned, round(cost_usd, 6) AS cost_usd, events FROM r", f"r AS ({ROLLUP_SQL})"))
