"""Registered queries: funnels, cohorts, rolling metrics, baseline anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import r6
from tallyloom.operators import anomaly as Q
from tallyloom.operators import cohorts as C
from tallyloom.operators import funnels as N
from tallyloom.operators import rolling as W
from tallyloom.plans.fixtures import table
from tallyloom.plans.session import written

QUERIES = {}
ORACLE = {}


def _add(key, run, sql=None):
    QUERIES[key] = run
    if sql is not None:
        ORACLE[key] = sql


# ---- funnels -------------------------------------------------------------

STEPS = (N.Step("view", "view"), N.Step("signup", "signup", (N.Condition("properties.k", "greater_than", 85),)), N.Step("purchase", "purchase", (N.Condition("properties.k", "greater_than", 90),)))
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _fevents(spark, sf_dir, start=START, end=END):
    return N.funnel_events(table(spark, sf_dir, "events"), STEPS, start, end, [N.Condition("value", "greater_than", 1)])


def _segmented(spark, sf_dir):
    """Journeys with the band of the first event's k as the user's segment."""
    k = F.get_json_object("props", "$.k").cast("int")
    band = F.when(k < 30, "low").when(k < 60, "mid").when(k < 90, "high").otherwise("")
    return N.funnel_journeys(_fevents(spark, sf_dir).withColumn("band", band), STEPS, keep=["band"])


def _journeys(spark, sf_dir, start=START, end=END):
    return N.funnel_journeys(_fevents(spark, sf_dir, start, end), STEPS)


_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"


def _fe(start=START, end=END, name="fe"):
    return (f"{name} AS (SELECT *, {_K} AS k FROM events WHERE event_type IN ('view', 'signup', 'purchase') "
            f"AND ts >= TIMESTAMP '{start}' AND ts <= TIMESTAMP '{end}' AND value > 1)")


def _journey_ctes(fe="fe", p=""):
    return (f"{p}s0 AS (SELECT user_id, min(ts) AS t0, arg_min(k, ts) AS fk FROM {fe} GROUP BY 1), "
            f"{p}s1 AS (SELECT user_id, min(ts) AS t1 FROM {fe} WHERE event_type = 'view' GROUP BY 1), "
            f"{p}s2 AS (SELECT e.user_id, min(ts) AS t2 FROM {fe} e JOIN {p}s1 ON {p}s1.user_id = e.user_id AND ts > t1 WHERE event_type = 'signup' AND k > 85 GROUP BY 1), "
            f"{p}s3 AS (SELECT e.user_id, min(ts) AS t3 FROM {fe} e JOIN {p}s2 ON {p}s2.user_id = e.user_id AND ts > t2 WHERE event_type = 'purchase' AND k > 90 GROUP BY 1), "
            f"{p}j AS (SELECT {p}s0.user_id, t0, t1, t2, t3, CASE WHEN fk < 30 THEN 'low' WHEN fk < 60 THEN 'mid' WHEN fk < 90 THEN 'high' ELSE 'unknown' END AS band, "
            f"CASE WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END AS n "
            f"FROM {p}s0 LEFT JOIN {p}s1 ON {p}s1.user_id = {p}s0.user_id LEFT JOIN {p}s2 ON {p}s2.user_id = {p}s0.user_id LEFT JOIN {p}s3 ON {p}s3.user_id = {p}s0.user_id)")


def _ms(a, b):
    return f"date_diff('microsecond', {a}, {b}) / 1000.0"


def _d(expr, alias):
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


J = "WITH " + _fe() + ", " + _journey_ctes() + " "

_add("F2_funnel_events", lambda s, d: _fevents(s, d).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")),
     "WITH " + _fe() + " SELECT event_type, user_id, count(*) AS n FROM fe GROUP BY 1, 2")


def _f3(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    conds = {
        "equals": N.Condition("properties.k", "equals", 7), "not_equals": N.Condition("event_type", "not_equals", "view"),
        "contains": N.Condition("event_type", "contains", "r"), "not_contains": N.Condition("props", "not_contains", "1"),
        "greater_than": N.Condition("properties.k", "greater_than", 50), "less_than": N.Condition("value", "less_than", 10.5),
        "missing_equals": N.Condition("properties.zz", "equals", "x"), "missing_not_equals": N.Condition("properties.zz", "not_equals", "x"),
    }
    return ev.groupBy("event_type").agg(*[F.count_if(N.step_condition(c)).alias(n) for n, c in conds.items()])


_add("F3_step_condition", _f3,
     "SELECT event_type, count(*) FILTER (WHERE k = 7) AS equals, count(*) FILTER (WHERE event_type <> 'view') AS not_equals, "
     "count(*) FILTER (WHERE contains(event_type, 'r')) AS contains, count(*) FILTER (WHERE NOT contains(props, '1')) AS not_contains, "
     "count(*) FILTER (WHERE k > 50) AS greater_than, count(*) FILTER (WHERE value < 10.5) AS less_than, "
     f"0::BIGINT AS missing_equals, count(*) AS missing_not_equals FROM (SELECT *, {_K} AS k FROM events) GROUP BY 1")


def _f4(spark, sf_dir):
    j = _journeys(spark, sf_dir)
    at = lambda i: F.try_element_at("step_us", F.lit(i))
    return j.select("user_id", "completed_steps", "dropoff_step", r6(F.col("conversion_ms")).alias("conversion_ms"),
                    *[r6((at(i) - F.col("start_us")) / 1000.0).alias(f"since_start_{i}") for i in (1, 2, 3)],
                    *[r6((at(i) - at(i - 1)) / 1000.0).alias(f"since_previous_{i}") for i in (2, 3)])


_add("F4_funnel_journeys", _f4, J + (
    "SELECT user_id, CAST(n AS INTEGER) AS completed_steps, CASE WHEN n < 3 THEN CAST(n + 1 AS INTEGER) END AS dropoff_step, "
    + ", ".join([_d(_ms("t0", "t3"), "conversion_ms"), _d(_ms("t0", "t1"), "since_start_1"), _d(_ms("t0", "t2"), "since_start_2"),
                 _d(_ms("t0", "t3"), "since_start_3"), _d(_ms("t1", "t2"), "since_previous_2"), _d(_ms("t2", "t3"), "since_previous_3")]) + " FROM j"))


def _steps_sql(src="j", group="", cols=""):
    sel = lambda i, base, gap: (
        f"SELECT {cols}{i} AS step, '{('view', 'signup', 'purchase')[i - 1]}' AS step_id, count(*) FILTER (WHERE n >= {i}) AS users, "
        f"coalesce({_d(f'count(*) FILTER (WHERE n >= {i}) / nullif({base}, 0)', 'x').replace(' AS x', '')}, 0) AS conversion_rate, "
        f"round(1 - coalesce(CAST(count(*) FILTER (WHERE n >= {i}) / nullif({base}, 0) AS DOUBLE), 0), 6) AS dropoff_rate, "
        f"coalesce(round(CAST({gap} AS DOUBLE), 6), 0) AS mean_ms_from_previous FROM {src}{group}")
    n = lambda i: f"count(*) FILTER (WHERE n >= {i})"
    return " UNION ALL ".join([sel(1, "count(*)", "0"), sel(2, n(1), f"avg({_ms('t1', 't2')})"), sel(3, n(2), f"avg({_ms('t2', 't3')})")])


_add("F5_funnel_steps", lambda s, d: _rounded(N.funnel_steps(_journeys(s, d), STEPS)), J + _steps_sql())
_SUMMARY = (f"count(*) AS users, {_d('count(*) FILTER (WHERE n = 3) / count(*)', 'completion_rate')}, "
            f"{_d('1 - count(*) FILTER (WHERE n = 3) / count(*)', 'dropoff_rate')}, "
            f"coalesce(round(avg({_ms('t0', 't3')}), 6), 0) AS mean_conversion_ms")
_add("F6_funnel_summary", lambda s, d: _rounded(N.funnel_summary(_journeys(s, d), STEPS)), J + f"SELECT {_SUMMARY} FROM j")
_add("F7_funnel_breakdown", lambda s, d: _rounded(N.funnel_breakdown(_segmented(s, d), STEPS, "band")).withColumn("rank", F.col("rank").cast("long")),
     J + "SELECT band AS value, users, round(rate, 6) AS conversion_rate, 'band' AS property, row_number() OVER (ORDER BY rate DESC, users DESC, band) AS rank "
     "FROM (SELECT band, count(*) AS users, count(*) FILTER (WHERE n = 3) / count(*) AS rate FROM j GROUP BY 1)")
_add("F8_funnel_by_segment", lambda s, d: _rounded(N.funnel_by_segment(_segmented(s, d), STEPS, "band")),
     J + f"SELECT a.segment, step, step_id, a.users, conversion_rate, a.dropoff_rate, mean_ms_from_previous, b.users AS segment_users, completion_rate, mean_conversion_ms FROM "
     f"({_steps_sql(group=' GROUP BY band', cols='band AS segment, ')}) a JOIN (SELECT band AS segment, {_SUMMARY} FROM j GROUP BY 1) b ON a.segment = b.segment")
_add("F9_conversion_paths", lambda s, d: _rounded(N.conversion_paths(_journeys(s, d), STEPS)),
     J + "SELECT CASE n WHEN 0 THEN '' WHEN 1 THEN 'view' WHEN 2 THEN 'view->signup' ELSE 'view->signup->purchase' END AS path, users, "
     "CASE WHEN n = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS conversion_rate, mean_ms, "
     "CASE WHEN n = 3 THEN 0.0::DOUBLE ELSE round(CAST(users / sum(users) OVER (ORDER BY n DESC) AS DOUBLE), 6) END AS dropoff_rate FROM "
     f"(SELECT n, count(*) AS users, coalesce(round(avg({_ms('t0', 't3')}), 6), 0) AS mean_ms FROM j GROUP BY n)")
_HALF = "2024-01-16 00:00:00"


def _f10(spark, sf_dir):
    return _rounded(N.compare_funnels(_journeys(spark, sf_dir, _HALF, END), _journeys(spark, sf_dir, START, _HALF), STEPS))


_add("F10_compare_funnels", _f10,
     "WITH " + _fe(_HALF, END, "fa") + ", " + _journey_ctes("fa", "a_") + ", " + _fe(START, _HALF, "fb") + ", " + _journey_ctes("fb", "b_")
     + ", c AS (SELECT count(*) AS u, count(*) FILTER (WHERE n = 3) / count(*) AS r FROM a_j), p AS (SELECT count(*) AS u, count(*) FILTER (WHERE n = 3) / count(*) AS r FROM b_j) "
     + " UNION ALL ".join(
         f"SELECT '{label}' AS metric, {_d('c.' + x, 'current_value')}, {_d('p.' + x, 'comparison_value')}, {_d(f'c.{x} - p.{x}', 'change')}, "
         f"coalesce(round(CAST((c.{x} - p.{x}) * 100 / nullif(p.{x}, 0) AS DOUBLE), 6), 0) AS change_percent FROM c, p"
         for label, x in (("Completion Rate", "r"), ("Total Users", "u"))))
_add("F11_funnel_insights", lambda s, d: _rounded(N.funnel_insights(N.funnel_steps(_journeys(s, d), STEPS))),
     J + "SELECT step, step_id, conversion_rate, dropoff_rate, CASE WHEN conversion_rate >= 0.8 THEN 'excellent' WHEN conversion_rate >= 0.6 THEN 'good' "
     "WHEN conversion_rate >= 0.3 THEN 'needs_improvement' ELSE 'poor' END AS performance, dropoff_rate > 0.5 AS high_dropoff, "
     f"round(least(0.95, conversion_rate * 1.2), 6) AS target_rate FROM ({_steps_sql()})")

# ---- cohorts -------------------------------------------------------------

PERIODS = 30


def _cohort(spark, sf_dir, unit="day"):
    ev = table(spark, sf_dir, "events").withColumn("medium", F.concat(F.lit("m"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string")))
    return C.cohort_users(ev.withColumn("source", F.col("event_type")), unit, keep=["source", "medium"])


def _activity(spark, sf_dir, unit="day"):
    return C.period_activity(table(spark, sf_dir, "events"), _cohort(spark, sf_dir), unit)


_SUN = "CAST(CAST({0} AS DATE) - CAST(dayofweek(CAST({0} AS DATE)) AS INTEGER) AS DATE)"
_CO = ("co AS (SELECT user_id, min(ts) AS cohort_date, arg_min(event_type, ts) AS source, "
       f"'m' || CAST(arg_min({_K}, ts) % 7 AS VARCHAR) AS medium, strftime(min(ts), '%Y-%m-%d') AS cohort FROM events GROUP BY 1)")
_AC = ("ac AS (SELECT e.user_id, cohort, CAST(floor(date_diff('microsecond', cohort_date, ts) / 86400000000) AS INTEGER) AS period, count(*) AS n, "
       "sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS revenue FROM events e JOIN co ON co.user_id = e.user_id WHERE ts >= cohort_date GROUP BY 1, 2, 3)")
_EN = "en AS (SELECT *, least(1.0, least(1.0, n / 10.0) + CASE WHEN revenue > 0 THEN 0.2 ELSE 0 END) AS engagement FROM ac)"
_RE = (f"re AS (SELECT s.cohort, s.size, p.period, coalesce(a.active, 0) AS active, coalesce(a.active, 0) / s.size AS retention FROM "
       f"(SELECT cohort, count(*) AS size FROM co GROUP BY 1) s CROSS JOIN (SELECT unnest(range({PERIODS})) AS period) p LEFT JOIN "
       "(SELECT cohort, period, count(*) AS active FROM ac GROUP BY 1, 2) a ON a.cohort = s.cohort AND a.period = p.period)")
_UE = ("ue AS (SELECT co.user_id, co.cohort, round(coalesce(avg(engagement), 0), 9) AS engagement, coalesce(sum(revenue), 0) AS revenue FROM co LEFT JOIN en ON en.user_id = co.user_id GROUP BY 1, 2)")
CW = f"WITH {_CO}, {_AC}, {_EN}, {_RE}, {_UE} "


def _c2(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    out = None
    for unit in ("day", "week", "month"):
        part = C.cohort_users(ev, unit, "signup", [N.Condition("properties.k", "greater_than", 10)]).select(F.lit(unit).alias("unit"), "user_id", "cohort")
        out = part if out is None else out.unionByName(part)
    return out


_add("C2_cohort_users", _c2,
     f"WITH f AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' AND {_K} > 10 GROUP BY 1) "
     "SELECT 'day' AS unit, user_id, strftime(t, '%Y-%m-%d') AS cohort FROM f UNION ALL SELECT 'month', user_id, strftime(t, '%Y-%m') FROM f "
     f"UNION ALL SELECT 'week', user_id, 'Week of ' || CAST({_SUN.format('t')} AS VARCHAR) FROM f")
_add("C3_period_activity", lambda s, d: _rounded(_activity(s, d)),
     CW + "SELECT user_id, cohort, period, n AS events, round(revenue, 6) AS revenue, round(CAST(engagement AS DOUBLE), 6) AS engagement FROM en")
_add("C4_cohort_retention", lambda s, d: _rounded(C.cohort_retention(_cohort(s, d), _activity(s, d), PERIODS)).withColumn("period", F.col("period").cast("long")),
     CW + f"SELECT cohort, size, period, active, {_d('retention', 'retention')} FROM re")
_add("C5_retention_curve", lambda s, d: _rounded(C.retention_curve(_cohort(s, d), _activity(s, d), PERIODS)).withColumn("period", F.col("period").cast("long")),
     CW + f"SELECT period, CAST(sum(size) AS BIGINT) AS users, CAST(sum(active) AS BIGINT) AS active, {_d('sum(active) / sum(size)', 'retention')}, "
     "CASE WHEN sum(size) < 100 THEN 0.6::DOUBLE WHEN sum(size) < 1000 THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM re GROUP BY 1")
_add("C6_retention_by_segment", lambda s, d: _rounded(C.retention_by_segment(_cohort(s, d), _activity(s, d), "source", PERIODS)).withColumn("period", F.col("period").cast("long")),
     CW + f"SELECT s.source, s.users, p.period, coalesce(a.active, 0) AS active, {_d('coalesce(a.active, 0) / s.users', 'retention')} FROM (SELECT source, count(*) AS users FROM co GROUP BY 1) s "
     f"CROSS JOIN (SELECT unnest(range({PERIODS})) AS period) p LEFT JOIN (SELECT source, period, count(*) AS active FROM ac JOIN co ON co.user_id = ac.user_id GROUP BY 1, 2) a ON a.source = s.source AND a.period = p.period")
_add("C7_cohort_summary", lambda s, d: _rounded(C.cohort_summary(C.cohort_retention(_cohort(s, d), _activity(s, d), PERIODS))),
     CW + f"SELECT count(*) AS cohorts, CAST(sum(size) AS BIGINT) AS total_users, {_d('avg(retention)', 'mean_retention')}, CASE WHEN count(*) < 2 THEN 'stable' "
     "WHEN avg(retention) FILTER (WHERE dn <= 3) > avg(retention) FILTER (WHERE up <= 3) * 1.05 THEN 'improving' "
     "WHEN avg(retention) FILTER (WHERE dn <= 3) < avg(retention) FILTER (WHERE up <= 3) * 0.95 THEN 'declining' ELSE 'stable' END AS trend FROM "
     "(SELECT *, row_number() OVER (ORDER BY cohort) AS up, row_number() OVER (ORDER BY cohort DESC) AS dn FROM re WHERE period = 1)")
_PERF = ("pf AS (SELECT s.cohort, s.size, coalesce(r.r1, 0) AS retention_1, CASE WHEN rec > old * 1.05 THEN 'improving' WHEN rec < old * 0.95 THEN 'declining' ELSE 'stable' END AS trend, "
         "s.revenue, s.revenue / s.size AS ltv, s.engagement FROM (SELECT cohort, count(*) AS size, sum(revenue) AS revenue, avg(engagement) AS engagement FROM ue GROUP BY 1) s JOIN "
         f"(SELECT cohort, max(retention) FILTER (WHERE period = 1) AS r1, avg(retention) FILTER (WHERE period >= {PERIODS - 3}) AS rec, avg(retention) FILTER (WHERE period < 3) AS old FROM re GROUP BY 1) r ON r.cohort = s.cohort)")
CP = CW.rstrip() + f", {_PERF} "


def _performance(spark, sf_dir):
    return C.cohort_performance(written(_cohort(spark, sf_dir), "cohort"), written(_activity(spark, sf_dir), "activity"), PERIODS)


_add("C8_cohort_performance", lambda s, d: _rounded(_performance(s, d)),
     CP + f"SELECT cohort, size, {_d('retention_1', 'retention_1')}, trend, {_d('revenue', 'revenue')}, {_d('ltv', 'ltv')}, {_d('engagement', 'engagement')} FROM pf")
_add("C9_acquisition_top5", lambda s, d: _rounded(C.acquisition_top(_cohort(s, d), ("source", "medium"))).withColumn("rank", F.col("rank").cast("long")),
     CW + "SELECT cohort, dimension, rank, name, users, round(CAST(users / size AS DOUBLE), 6) AS share FROM (SELECT x.*, s.size, row_number() OVER (PARTITION BY x.cohort, dimension ORDER BY users DESC, name) AS rank FROM "
     "(SELECT cohort, 'source' AS dimension, source AS name, count(*) AS users FROM co GROUP BY 1, 3 UNION ALL SELECT cohort, 'medium', medium, count(*) FROM co GROUP BY 1, 3) x "
     "JOIN (SELECT cohort, count(*) AS size FROM co GROUP BY 1) s ON s.cohort = x.cohort) WHERE rank <= 5")


def _c10(spark, sf_dir):
    co, ac = written(_cohort(spark, sf_dir), "cohort"), written(_activity(spark, sf_dir), "activity")
    return _rounded(C.engagement_histogram(co, ac).join(C.cohort_engagement(co, ac), "cohort"))


_add("C10_cohort_engagement", _c10,
     CW + f"SELECT h.cohort, h.score, h.users, m.mean_engagement, m.high_users, m.low_users FROM (SELECT cohort, {_d('floor(engagement * 10) / 10', 'score')}, count(*) AS users FROM ue GROUP BY 1, 2) h JOIN "
     f"(SELECT cohort, {_d('avg(engagement)', 'mean_engagement')}, count(*) FILTER (WHERE engagement > 0.7) AS high_users, count(*) FILTER (WHERE engagement < 0.3) AS low_users FROM ue GROUP BY 1) m ON m.cohort = h.cohort")


def _c11(spark, sf_dir):
    """The same users under two cohort definitions: by any first event, by first purchase."""
    ev = table(spark, sf_dir, "events")
    sets = None
    for name, kind in (("any", None), ("buyers", "purchase")):
        co = written(C.cohort_users(ev, "day", kind), "cohort")
        perf = C.cohort_performance(co, written(C.period_activity(ev, co, "day"), "activity"), PERIODS).withColumn("set_id", F.lit(name))
        sets = perf if sets is None else sets.unionByName(perf)
    out, sets = None, written(sets, "performance")
    for m in ("retention", "revenue", "engagement"):
        part = C.compare_cohorts(sets, "set_id", m)
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


_BUY = CP.replace("FROM events GROUP BY 1)", "FROM events WHERE event_type = 'purchase' GROUP BY 1)")
_add("C11_compare_cohorts", _c11, " UNION ALL ".join(
    f"SELECT '{n}' AS set_id, * FROM ({ctes} SELECT {_d('avg(retention_1)', 'performance')}, 'retention' AS metric FROM pf UNION ALL "
    f"SELECT round(avg(ltv), 6), 'revenue' FROM pf UNION ALL SELECT round(avg(engagement), 6), 'engagement' FROM pf)"
    for n, ctes in (("any", CP), ("buyers", _BUY))))
_add("C12_cohort_health", lambda s, d: _rounded(C.cohort_health(_performance(s, d), ["cohort"])),
     CP + "SELECT cohort, round(rh, 6) AS retention_health, round(eh, 6) AS engagement_health, 75.0::DOUBLE AS revenue_health, round((rh + eh + 75) / 3, 6) AS overall, "
     "CASE WHEN (rh + eh + 75) / 3 >= 80 THEN 'excellent' WHEN (rh + eh + 75) / 3 >= 60 THEN 'good' WHEN (rh + eh + 75) / 3 >= 40 THEN 'warning' ELSE 'critical' END AS grade, "
     "CASE WHEN (rh + eh + 75) / 3 < 50 THEN 'high' WHEN (rh + eh + 75) / 3 < 70 THEN 'medium' ELSE 'low' END AS churn_risk FROM "
     "(SELECT cohort, least(avg(retention_1) * 100, 100) AS rh, avg(engagement) * 100 AS eh FROM pf GROUP BY 1)")


def _c13(spark, sf_dir):
    ms = (C.CustomMetric("errors", "error", "count"), C.CustomMetric("k_sum", "click", "sum", "properties.k"),
          C.CustomMetric("spend", "purchase", "average", "value", (N.Condition("value", "greater_than", 5),)), C.CustomMetric("k_kinds", "view", "unique", "properties.k"))
    return _rounded(C.custom_metrics(table(spark, sf_dir, "events"), _cohort(spark, sf_dir), ms, "week"))


_add("C13_custom_metrics", _c13,
     f"WITH {_CO} SELECT cohort, CAST(floor(date_diff('microsecond', cohort_date, ts) / 604800000000) AS INTEGER) AS period, "
     "CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS errors, "
     f"coalesce(CAST(sum({_K}) FILTER (WHERE event_type = 'click') AS DOUBLE), 0) AS k_sum, "
     "round(avg(value) FILTER (WHERE event_type = 'purchase' AND value > 5), 6) AS spend, "
     f"CAST(count(DISTINCT {_K}) FILTER (WHERE event_type = 'view') AS DOUBLE) AS k_kinds FROM events e JOIN co ON co.user_id = e.user_id WHERE ts >= cohort_date GROUP BY 1, 2")

# ---- rolling metrics -----------------------------------------------------

WIN_MS = 6 * 3600 * 1000


def _rolled(spark, sf_dir, percentiles=True):
    return W.rolling_aggregate(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id", WIN_MS, percentiles)


_LISTS = ("r0 AS (SELECT event_id, event_type, ts, value, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vs, "
          "list(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tt FROM events), "
          "r1 AS (SELECT event_id, event_type, ts, value, vs[len(vs) - len(list_filter(tt, lambda x: x >= ts - INTERVAL 6 HOUR)) + 1:] AS l FROM r0), "
          "ro AS (SELECT event_id, event_type, ts, value, l, list_sort(l) AS s, len(l) AS n FROM r1)")


def _nr(p):
    return f"s[CAST(greatest(ceil(n * {p}::DOUBLE), 1) AS INTEGER)]"


_add("W1_rolling_aggregate", lambda s, d: _rounded(_rolled(s, d, False)).select("event_type", "event_id", "value", "min", "max", "avg", "sum", "count"),
     f"WITH {_LISTS} SELECT event_type, event_id, round(value, 6) AS value, round(s[1], 6) AS min, round(s[n], 6) AS max, round(list_avg(l), 6) AS avg, round(list_sum(l), 6) AS sum, CAST(n AS INTEGER) AS count FROM ro")
_add("W2_nearest_rank_percentiles", lambda s, d: _rounded(_rolled(s, d)).select("event_type", "event_id", "p50", "p90", "p95", "p99"),
     f"WITH {_LISTS} SELECT event_type, event_id, " + ", ".join(f"round({_nr(p)}, 6) AS {n}" for n, p in W.PERCENTILES.items()) + " FROM ro")


def _rates(spark, sf_dir):
    return W.metric_rate(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


_add("W3_metric_rate", lambda s, d: _rates(s, d).select("event_type", "event_id", r6(F.col("rate")).alias("rate")),
     "SELECT event_type, event_id, CASE WHEN date_diff('microsecond', pt, ts) > 0 THEN round((value - pv) / (date_diff('microsecond', pt, ts) / 1000000.0), 6) ELSE 0.0::DOUBLE END AS rate FROM "
     "(SELECT *, lag(ts) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))")
_TREND = ("CASE WHEN n < 3 THEN 'stable' WHEN (b - a) * 100 / nullif(a, 0) > 5 THEN 'up' WHEN (b - a) * 100 / nullif(a, 0) < -5 THEN 'down' ELSE 'stable' END")
_HALVES = ("hv AS (SELECT *, list_avg(z[1:len(z) // 2]) AS a, list_avg(z[len(z) // 2 + 1:]) AS b FROM (SELECT *, l[greatest(n - 9, 1):] AS z FROM ro))")
_add("W4_metric_trend", lambda s, d: _rolled(s, d, False).select("event_type", "event_id", "trend"),
     f"WITH {_LISTS}, {_HALVES} SELECT event_type, event_id, {_TREND} AS trend FROM hv")
_add("W5_metric_history", lambda s, d: W.metric_history(table(s, d, "events"), "ts", "2024-01-20 12:00:00", 36 * 3600 * 1000).select("event_id", "event_type", "value"),
     "SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00'")

# ---- baseline anomalies --------------------------------------------------


def _baselined(spark, sf_dir):
    return Q.update_baseline(_rolled(spark, sf_dir), "event_type", "event_id")


_BASE = (f"b0 AS (SELECT event_id, event_type, ts, value, {_nr(0.5)} AS p50, {_nr(0.9)} AS p90, count(*) OVER w AS points, avg(value) OVER w AS mean FROM ro WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), "
         "b1 AS (SELECT *, sqrt(sum((value - mean) * (value - mean)) OVER (PARTITION BY event_type ORDER BY event_id) / points) AS std_dev FROM b0), "
         "bl AS (SELECT *, p50 AS median, p50 - (p90 - p50) / 2 AS q1, p90 AS q3, p90 - (p50 - (p90 - p50) / 2) AS iqr, abs(value - p50) * 1.4826 AS mad FROM b1)")
_add("Q1_update_baseline", lambda s, d: _rounded(_baselined(s, d).withColumn("total", F.col("mean") * F.col("points"))).select("event_type", "event_id", "points", "total", "std_dev", "median", "q1", "q3", "iqr", "mad"),
     f"WITH {_LISTS}, {_BASE} SELECT event_type, event_id, points, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("total", "std_dev", "median", "q1", "q3", "iqr", "mad")) + " FROM (SELECT *, mean * points AS total FROM bl)")


def _detected(spark, sf_dir, method):
    return _rounded(Q.judge(_baselined(spark, sf_dir), "event_type", "event_id", [method])).select("event_type", "event_id", "hit", "confidence", "lo", "hi")


def _conf(x, den):
    return f"round(CASE WHEN {den} = 0 THEN CASE WHEN {x} > 0 THEN 1.0 END ELSE least(({x}) / ({den}), 1.0) END, 6)"


_DET = {
    "Q2_detect_statistical": ("statistical", "mean - 3 * std_dev", "mean + 3 * std_dev", "value < mean - 3 * std_dev OR value > mean + 3 * std_dev", _conf("abs(value - mean)", "(3 * std_dev)")),
    "Q3_detect_z": ("zscore", "mean - 2.5 * std_dev", "mean + 2.5 * std_dev", "abs(value - mean) > 2.5 * std_dev", _conf("abs(value - mean)", "(2.5 * std_dev)")),
    "Q4_detect_mad": ("mad", "median - 3 * mad / 0.6745", "median + 3 * mad / 0.6745", "0.6745 * abs(value - median) > 3 * mad", _conf("0.6745 * abs(value - median)", "(3 * mad)")),
    "Q5_detect_iqr": ("iqr", "q1 - 1.5 * iqr", "q3 + 1.5 * iqr", "value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr",
                      "coalesce(" + _conf("greatest(q1 - 1.5 * iqr - value, value - q3 - 1.5 * iqr, 0)", "iqr") + ", 0)"),
}
for _key, (_m, _lo, _hi, _hit, _cf) in _DET.items():
    _add(_key, (lambda m: lambda s, d: _detected(s, d, m))(_m),
         f"WITH {_LISTS}, {_BASE} SELECT event_type, event_id, ({_hit}) AS hit, {_cf} AS confidence, round({_lo}, 6) AS lo, round({_hi}, 6) AS hi FROM bl")


def _q6(spark, sf_dir):
    """Readings two orders of magnitude smaller, so that a rate per second can exceed half of one."""
    ev = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, F.col("value") / 1e6).otherwise(F.col("value")))
    rolled = W.rolling_aggregate(ev, "event_type", "ts", "v", "event_id", WIN_MS)
    rates = W.metric_rate(ev, "event_type", "ts", "v", "event_id").select("event_id", "rate")
    base = Q.update_baseline(rolled, "event_type", "event_id").join(rates, "event_id")
    return Q.detect(base, "event_type", "event_id", ["pattern"], gated=False).select("event_type", "event_id", "confidence")


_SMALL = _LISTS.replace("FROM events), r1", "FROM ev), r1")
_add("Q6_detect_pattern", _q6,
     f"WITH ev AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 5 = 0 THEN value / 1e6 ELSE value END AS value FROM events), {_SMALL}, {_HALVES}, "
     "rt AS (SELECT event_id, CASE WHEN date_diff('microsecond', pt, ts) > 0 THEN (value - pv) / (date_diff('microsecond', pt, ts) / 1000000.0) ELSE 0 END AS rate FROM "
     "(SELECT *, lag(ts) OVER w AS pt, lag(value) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))) "
     f"SELECT event_type, event_id, 0.8::DOUBLE AS confidence FROM (SELECT hv.*, rate, {_TREND} AS trend FROM hv JOIN rt ON rt.event_id = hv.event_id) "
     "WHERE (trend = 'up' AND rate > 0 AND rate > value * 0.5) OR (trend = 'down' AND rate <> 0 AND abs(rate) > value * 0.5)")

_TH = 0.3


def _daily_users(spark, sf_dir):
    """One metric per user decile and type: the daily sums, as readings."""
    ev = table(spark, sf_dir, "events")
    name = F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string"))
    return ev.groupBy(name.alias("metric"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("value"))


def _pairs(spark, sf_dir):
    return Q.correlated_metrics(_daily_users(spark, sf_dir), "metric", "day", "value", _TH)


_PAIRS = ("dm AS (SELECT event_type || '_' || CAST(user_id % 10 AS VARCHAR) AS metric, CAST(ts AS DATE) AS day, round(sum(value), 4) AS value FROM events GROUP BY 1, 2), "
          "po AS (SELECT metric, day, value, value - avg(value) OVER (PARTITION BY metric) AS x, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY day) AS i FROM dm), "
          "pr AS (SELECT a.metric AS metric1, b.metric AS metric2, sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 0) AS r FROM po a JOIN po b ON a.metric < b.metric AND a.i = b.i "
          "WHERE a.n >= 10 AND b.n >= 10 GROUP BY 1, 2)")
_add("Q7_correlated_metrics", lambda s, d: _rounded(_pairs(s, d)),
     f"WITH {_PAIRS} SELECT metric1, metric2, round(r, 6) AS correlation FROM pr WHERE abs(r) >= {_TH}")


def _q8(spark, sf_dir):
    d = _daily_users(spark, sf_dir)
    current = d.groupBy("metric").agg(F.max_by("value", "day").alias("value"), F.avg("value").alias("mean"))
    return _rounded(Q.correlation_breaks(_pairs(spark, sf_dir), current))


_add("Q8_correlation_breaks", _q8,
     f"WITH {_PAIRS}, cu AS (SELECT metric, arg_max(value, day) AS value, avg(value) AS mean FROM dm GROUP BY 1), "
     "x AS (SELECT metric1, metric2, a.value / nullif(b.value, 0) AS act, a.mean / nullif(b.mean, 0) AS ex FROM pr JOIN cu a ON a.metric = metric1 JOIN cu b ON b.metric = metric2 "
     f"WHERE abs(r) >= {_TH}) SELECT metric1, metric2, round(act, 6) AS value, round(ex * 0.7, 6) AS lo, round(ex * 1.3, 6) AS hi, CASE WHEN abs(act - ex) / ex > 0.5 THEN 'high' ELSE 'medium' END AS severity, "
     "round(least(abs(act - ex) / ex, 1.0), 6) AS confidence FROM x WHERE abs(act - ex) / ex > 0.3")


def _gated(spark, sf_dir):
    return Q.detect(_baselined(spark, sf_dir), "event_type", "event_id", ["statistical", "zscore", "mad", "iqr"], sensitivity=0.5)


_add("Q9_anomaly_severity", lambda s, d: _rounded(_gated(s, d)).select("event_type", "event_id", "method", "severity", "alert_severity"), None)
_ALLDET = " UNION ALL ".join(
    f"SELECT event_type, event_id, value, '{m}' AS method, {cf} AS conf, {lo} AS lo, {hi} AS hi FROM bl WHERE points >= 10 AND ({hit})" for m, lo, hi, hit, cf in _DET.values())
_FAR = "greatest((value - hi) / nullif(hi - lo, 0), (lo - value) / nullif(hi - lo, 0))"
_SEV = (f"sv AS (SELECT *, CASE WHEN {_FAR} > 2 AND conf > 0.9 THEN 'critical' WHEN {_FAR} > 1.5 AND conf > 0.8 THEN 'high' WHEN {_FAR} > 1 AND conf > 0.7 THEN 'medium' ELSE 'low' END AS severity "
        f"FROM ({_ALLDET}) WHERE conf >= 0.5)")
ORACLE["Q9_anomaly_severity"] = (
    f"WITH {_LISTS}, {_BASE}, {_SEV} SELECT event_type, event_id, method, severity, CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END AS alert_severity FROM sv")


def _q10(spark, sf_dir):
    """Health per event type and hour of the readings."""
    at = table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"))
    return _rounded(Q.health_score(_gated(spark, sf_dir).join(at, "event_id"), ["event_type", "hour"]))


_add("Q10_health_score", _q10,
     f"WITH {_LISTS}, {_BASE}, {_SEV} SELECT sv.event_type, date_trunc('hour', ts) AS hour, greatest(0, 100 - count(*) FILTER (WHERE severity = 'critical') * 20 - count(*) FILTER (WHERE severity = 'high') * 10 "
     "- count(*) FILTER (WHERE severity NOT IN ('critical', 'high')) * 2) AS score, count(*) AS anomalies, count(*) FILTER (WHERE severity = 'critical') AS critical, round(avg(conf), 6) AS confidence "
     "FROM sv JOIN events e ON e.event_id = sv.event_id GROUP BY 1, 2")
