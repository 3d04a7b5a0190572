import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.quantiles import grouped_quantiles, value_range
from tallyloom.operators import benchmark as B
from tallyloom.operators import billing as BL
from tallyloom.operators import metrics as M
from tallyloom.sources import events as S

ARGS = M.MetricArgs("t", "2024-01-01 00:00:00", "2024-01-02 00:00:00", pivot="2024-01-01 12:00:00")


def outcome_rows():
    rows = [{"event": "task_completed", "cost_usd": 0.7}] * 6 + [{"event": "task_failed"}] * 3 + [{"event": "task_abandoned"}]
    return [dict(r) for r in rows]


def value(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]["value"]


def test_success_and_cost(make_events):
    ev = make_events(outcome_rows())
    assert value(M.metric("task_success_rate", ev, ARGS)) == pytest.approx(0.6)
    assert value(M.metric("cost_per_completed_task", ev, ARGS)) == pytest.approx(0.7)
    assert value(M.metric("abandonment_rate", ev, ARGS)) == pytest.approx(0.1)


def test_redelivery_changes_nothing(make_events):
    ev = make_events(outcome_rows())
    twice = ev.unionByName(ev)
    assert value(M.metric("cost_per_completed_task", twice, ARGS)) == pytest.approx(0.7)
    panel = {r["metric"]: r["value"] for r in M.metric_panel(twice, ARGS).collect()}
    assert panel["task_success_rate"] == pytest.approx(0.6)
    rollup = M.daily_rollup_build(S.dedupe_events(twice)).collect()
    assert (rollup[0]["completed"], rollup[0]["ended"], rollup[0]["events"]) == (6, 10, 10)


def test_last_insert_wins(make_events):
    ev = make_events([{"event": "step_executed", "status": "ok", "event_id": "e"}]).withColumn("seq", F.lit(1))
    newer = ev.withColumn("status", F.lit("error")).withColumn("seq", F.lit(2))
    assert [r["status"] for r in S.dedupe_events(newer.unionByName(ev), "seq").collect()] == ["error"]


def test_no_data_is_null_and_guarded_is_zero(make_events):
    ev = make_events([{"event": "feedback_given", "rating_value": 1}])
    assert value(M.metric("cost_per_completed_task", ev, ARGS)) is None
    assert value(M.metric("complaint_rate", ev, ARGS)) == 0.0


def test_half_open_window(make_events):
    ev = make_events([{"event": "task_completed", "timestamp": "2024-01-01 00:00:00"}, {"event": "task_failed", "timestamp": "2024-01-02 00:00:00"}])
    assert value(M.metric("task_success_rate", ev, ARGS)) == 1.0


def test_refusals(make_events):
    with pytest.raises(ValueError):
        M.metric("task_success_rate", None, M.MetricArgs("", "2024-01-01", "2024-01-02"))
    with pytest.raises(ValueError):
        M.check_args("nope", ARGS)
    with pytest.raises(ValueError):
        M.check_args("task_success_rate", M.MetricArgs("t", "a", "b", segment_by="payload"))
    with pytest.raises(ValueError):
        M.check_args("regression_delta", M.MetricArgs("t", "a", "b"))
    assert len(M.list_metrics()) == 22


def test_query_ids_are_stable_and_sensitive():
    a = M.query_id("task_success_rate", ARGS)
    assert a == M.query_id("task_success_rate", ARGS)
    assert a != M.query_id("task_success_rate", M.MetricArgs("u", ARGS.start, ARGS.end))
    assert a.startswith("q_") and len(a) == 18


def test_per_arm(make_events, spark):
    ev = make_events([{"event": "task_completed", "task_id": "a"}, {"event": "task_failed", "task_id": "b"},
                      {"event": "task_completed", "task_id": "c"}, {"event": "task_completed", "task_id": "d"}])
    ex = spark.createDataFrame([("a", "control"), ("b", "control"), ("c", "variant"), ("d", "variant")], "subject string, arm string")
    got = {r["arm"]: r["value"] for r in M.per_arm_metric(ev, ex, "task_success_rate", ARGS).collect()}
    assert got == {"control": 0.5, "variant": 1.0}


def test_usage_tiers_and_invoice(make_events, spark):
    ev = make_events([{"event": "task_completed", "task_id": "a", "run_id": r} for r in ("1", "2", "2")] + [{"event": "task_failed", "task_id": "b"}])
    u = BL.usage_meters(ev, ARGS)
    r = u.collect()[0]
    assert (r["events_ingested"], r["tasks_tracked"], r["agent_runs"], r["tasks_completed"]) == (4, 2, 3, 1)
    usage = spark.createDataFrame([("a", 10, 1, 1), ("b", 60_000, 1, 1), ("c", 1, 1, 5_000), ("d", 99_000_000, 1, 1)],
                                  "tenant_id string, events_ingested long, tasks_tracked long, agent_runs long")
    assert {r["tenant_id"]: r["tier"] for r in BL.resolve_tier(usage).collect()} == {"a": "free", "b": "starter", "c": "growth", "d": "growth"}
    inv = BL.task_invoice(spark.createDataFrame([("a", 900), ("b", 1500)], "tenant_id string, tasks_completed long")).collect()
    assert {r["tenant_id"]: (r["billable_tasks"], r["amount_usd"]) for r in inv} == {"a": (0, 0.0), "b": (500, 25.0)}
    with pytest.raises(Exception):
        BL.task_invoice(spark.createDataFrame([("a", -1)], "tenant_id string, tasks_completed long")).collect()


def test_benchmark_suppression(spark):
    rows = [("m", f"t{i}", v) for i, v in enumerate((0.5, 0.55, 0.6, 0.62, 0.71))] + [("small", f"t{i}", 0.5) for i in range(3)] + [("m", "out", 9.0)]
    c = spark.createDataFrame(rows, "metric string, tenant_id string, value double")
    optin = spark.createDataFrame([(f"t{i}",) for i in range(5)], "tenant_id string")
    got = {(r["metric"], r["tenant_id"]): r for r in B.benchmark(c, optin).collect()}
    assert ("m", "out") not in got
    assert got["m", "t4"]["mean"] == 0.596 and got["m", "t4"]["own_percentile"] == 80 and got["m", "t0"]["own_percentile"] == 1
    assert got["small", "t0"]["suppressed"] and got["small", "t0"]["mean"] is None and got["small", "t0"]["n"] == 3


def test_entry_module_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); own = [n for n in q if n != \"pipeline\" and not n.startswith(\"op\")]; assert len(own) == 162 and set(o) <= set(q), len(own)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_last_insert_wins_and_filters_follow_it(spark, make_events):
    from pyspark.sql import functions as F

    rows = make_events([
        {"event": "step_executed", "event_id": "a", "task_id": "t1", "tool_name": "search", "status": "error", "timestamp": "2024-01-01 00:00:00"},
        {"event": "step_executed", "event_id": "a", "task_id": "t1", "tool_name": "", "status": "ok", "timestamp": "2024-01-01 00:00:00"},
    ]).withColumn("inserted_at", F.when(F.col("tool_name") == "", 2).otherwise(1))
    args = M.MetricArgs(M.ALL_TENANTS if hasattr(M, "ALL_TENANTS") else ALL_TENANTS, "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    # the corrected copy has no tool, so there is nothing to report
    assert M.metric("per_tool_failure_rate", rows, args).count() == 0


def test_quantiles_of_small_and_mixed_values(spark):
    """Ranges are relative at every magnitude, and order holds over zero and signs."""
    values = [0.0, -3.5, 1e-9, 2.5e-9, 1e-300, 7.0, -1e-12, 0.0031, 0.0032, 5e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = grouped_quantiles(df, [], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).collect()[0]
    want = [float(np.quantile(values, p)) for p in (0.0, 0.25, 0.5, 0.9, 1.0)]
    assert list(got) == pytest.approx(want, rel=1e-12)
    small = spark.range(4000).select((F.col("id") / 1e6).alias("v"))
    assert small.groupBy(value_range(F.col("v"))).count().agg(F.max("count")).first()[0] < 40
