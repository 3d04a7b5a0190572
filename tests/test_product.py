import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evals as G
from tallyloom.operators import experiments as X
from tallyloom.operators import funnels as N
from tallyloom.operators import runs as R
from tallyloom.sources.events import Scope

STEPS = (N.Step("a", "a"), N.Step("b", "b"), N.Step("c", "c"), N.Step("d", "a"))


def test_funnel_fold_against_brute_force(spark):
    """Random users, ties and one user with most of the events, over many days."""
    rnd = random.Random(11)
    rows = []
    for _ in range(900):
        user = 0 if rnd.random() < 0.5 else rnd.randrange(1, 60)
        rows.append((user, rnd.choice("abcx"), rnd.randrange(0, 10 * 24) * 3600, "{}"))
    df = spark.createDataFrame(rows, "user_id int, event_type string, sec long, props string").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r["user_id"]: [t // 1_000_000 for t in r["step_us"]] for r in N.funnel_journeys(df, STEPS).collect()}
    for user in {r[0] for r in rows}:
        mine = sorted((s, t) for u, t, s, _ in rows if u == user)
        done, last = [], None
        for step in STEPS:
            hit = [s for s, t in mine if t == step.event_type and (last is None or s > last)]
            if not hit:
                break
            last = hit[0]
            done.append(last)
        assert got[user] == done


def test_funnel_definition_is_checked():
    with pytest.raises(ValueError):
        N.check_funnel([STEPS[0]])
    with pytest.raises(ValueError):
        N.check_funnel([STEPS[0], N.Step("b", "b", (N.Condition("x", "like", 1),))])


def test_run_reconstruction(make_events):
    rows = [{"event": "task_started"}, {"event": "step_executed", "tool_name": "search", "status": "ok", "tokens_in": 300, "tokens_out": 100, "latency_ms": 50},
            {"event": "step_executed", "tool_name": "mail", "status": "error", "retry_of_step_id": "s1", "tokens_in": 80, "latency_ms": 100},
            {"event": "human_approved", "agent_name": "helper"}, {"event": "task_completed", "cost_usd": 0.4}]
    ev = make_events([{"task_id": "k", "agent_name": "main", **r} for r in rows])
    r = R.reconstruct_runs(ev).collect()[0]
    assert (r["outcome"], r["steps"], r["errors"], r["retries"], r["tokens"], r["cost_usd"]) == ("completed", 2, 1, 1, 480.0, 0.4)
    assert r["agents"] == ["main", "helper"] and r["session_id"] is None
    bars = R.waterfall(ev).orderBy("pos").collect()
    assert [b["highlight"] for b in bars] == ["none", "error", "human"] and bars[0]["share"] == 0.5
    assert bars[0]["detail"] == "50ms · 400 tok"
    facts = G.trajectory_facts(ev)
    scores = {s["scorer_id"]: (s["value"], s["label"]) for s in G.score_runs(facts).collect()}
    assert scores["task_completed"][0] == 1.0 and scores["clean_trajectory"] == (0.0, "failed_steps:1")
    assert scores["low_retry_churn"][0] == 0.5 and scores["no_human_intervention"][0] == 1.0


def test_failure_clusters(make_events):
    ev = make_events([{"event": "step_executed", "tool_name": "crm", "status": "error"}, {"event": "step_executed", "tool_name": "crm", "status": "error"},
                      {"event": "step_executed", "tool_name": "crm", "status": "timeout"}, {"event": "human_overrode"}, {"event": "step_executed", "tool_name": "crm", "status": "ok"}])
    c = R.cluster_failures(R.failure_rows(ev, Scope("t", "2024-01-01", "2024-01-02"))).orderBy("rank").collect()
    assert [r["member_count"] for r in c] == [2, 1, 1] and c[0]["label"] == "crm error on x"


def _arms(spark, p_control, p_variant, n, seed, trials=1):
    rnd = random.Random(seed)
    rows = []
    for t in range(trials):
        for i in range(n):
            rows.append((t, i, "control", float(rnd.random() < p_control)))
            rows.append((t, i, "variant", float(rnd.random() < p_variant)))
    return spark.createDataFrame(rows, "exp int, i long, arm string, value double")


def test_peeking_keeps_the_error_rate(spark):
    path = X.sequential_path(_arms(spark, 0.5, 0.5, 300, 1, 40), ["exp"], ["i"], F.floor(F.col("i") / 64))
    stops = X.first_stop(path, ["exp"])
    assert stops.where(F.col("stopped_at").isNotNull()).count() <= 2
    assert path.count() == 40 * 300


def test_sequential_decisions(spark):
    assert X.sequential_evaluate(_arms(spark, 0.5, 0.75, 2000, 2), ["exp"]).collect()[0]["decision"] == "ship"
    assert X.sequential_evaluate(_arms(spark, 0.75, 0.5, 2000, 2), ["exp"]).collect()[0]["decision"] == "revert"
    only = _arms(spark, 0.5, 0.5, 10, 2).where("arm = 'control'")
    r = X.sequential_evaluate(only, ["exp"]).collect()[0]
    assert r["decision"] == "inconclusive" and r["effect"] == 0.0 and r["upper"] == float("inf")


def test_sample_size_and_hash(spark):
    df = spark.createDataFrame([(0.5, 0.1)], "b double, d double")
    assert X.sample_size(df, "b", "d").collect()[0]["per_arm"] == 385
    users = spark.createDataFrame([("u1",), ("ünïcode 😀",), ("x" * 40,)], "user_id string")
    got = {r["user_id"]: r["variant"] for r in X.assign_variant(users, "e", (X.Variant("a", 0.5, True), X.Variant("b", 0.5))).collect()}
    for u in got:
        h = 0
        data = f"{u}_e".encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = (h * 31 + int.from_bytes(data[i:i + 2], "little")) & 0xFFFFFFFF
        h = abs(h - (1 << 32) if h >= 1 << 31 else h) / 2147483647
        assert got[u] == ("a" if h <= 0.5 else "b" if h <= 1 else "a")


def test_judge_agreement_takes_the_last(spark):
    rows = [("x", "judge", 1, 0.9), ("x", "human", 1, 0.1), ("x", "human", 2, 0.8), ("y", "judge", 1, 0.2), ("y", "human", 1, 0.9), ("z", "judge", 1, 0.5)]
    r = G.judge_agreement(spark.createDataFrame(rows, "k string, kind string, seq int, value double"), ["k"], "seq").collect()[0]
    assert (r["pairs"], r["agreement"]) == (2, 0.5)


def test_journeys_of_one_hot_user_over_blocks_cut_by_counts(spark, monkeypatch):
    """A user with most of the events, equal times at block borders, blocks of three moments folded two at a time."""
    monkeypatch.setattr(N, "FOLDED", 2)
    rnd, steps = random.Random(11), [N.Step(c, c) for c in "abcd"]
    for most, span in ((40, 25), (60, 200), (7, 3)):
        rows = [("hot" if rnd.random() < 0.8 else rnd.choice("xyz"), rnd.randrange(span), rnd.choice("aabbcde")) for _ in range(most)] + [(None, 1, "a"), (None, 2, "b"), ("late", None, "a")]
        df = spark.createDataFrame(rows, "user_id string, s int, event_type string").select("user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_type", F.lit("{}").alias("props"))
        got = {r["user_id"]: ([t // 1_000_000 for t in r["step_us"]], r["start_us"]) for r in N.funnel_journeys(df, steps, rows_per_block=3).collect()}
        assert got.keys() == {u for u, _, _ in rows}
        for u, (times, start) in got.items():
            mine, expected = [(t, e) for v, t, e in rows if v == u and t is not None], []
            for s in steps:
                later = [t for t, e in mine if e == s.event_type and (not expected or t > expected[-1])]
                if not later:
                    break
                expected.append(min(later))
            assert times == expected and start == (min(t for t, _ in mine) * 1_000_000 if mine else None)
