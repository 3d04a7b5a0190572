import functools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.blocks import positions, side_moments, with_previous
from tallyloom.functions.quantiles import grouped_quantiles
from tallyloom.operators import anomaly as Q
from tallyloom.operators import rolling as W
from tallyloom.operators import series as P

TEN = [10, 10.5, 9.8, 10.2, 9.9, 10.1, 10.3, 9.7, 10.0, 10.2, 40.0]


def series(spark, values, key="s"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "s string, i long, v double")


@pytest.mark.parametrize("fn", [P.anomaly_zscore, P.anomaly_mad, P.anomaly_iqr])
def test_outlier_gap_and_short_history(spark, fn):
    got = {r["i"]: r for r in fn(series(spark, TEN), ["s"], "i", "v").collect()}
    assert got[10]["anomalous"] and not any(got[i]["anomalous"] for i in range(5))
    gap = {r["i"]: r for r in fn(series(spark, TEN[:6] + [None] + TEN[6:]), ["s"], "i", "v").collect()}
    assert gap[6]["anomalous"] is None and gap[11]["anomalous"]
    short = fn(series(spark, [10, 11, 40]), ["s"], "i", "v").collect()
    assert all(r["insufficient"] for r in short)


def test_constant_history_gives_zero_or_infinity(spark):
    for fn in (P.anomaly_zscore, P.anomaly_mad):
        got = {r["i"]: r["score"] for r in fn(series(spark, [0.1] * 7 + [0.2]), ["s"], "i", "v").collect()}
        assert got[6] == 0.0 and math.isinf(got[7])


def test_expanding_mad_against_brute_force(spark):
    rnd = random.Random(7)
    values = [round(rnd.gauss(10, 4), 2) if rnd.random() > 0.1 else None for _ in range(80)]
    got = {r["i"]: r for r in P.anomaly_mad(series(spark, values), ["s"], "i", "v").collect()}
    for i, v in enumerate(values):
        hist = [x for x in values[:i] if x is not None]
        if v is None or len(hist) < 5:
            continue
        med = statistics.median(hist)
        assert got[i]["median"] == pytest.approx(med)
        assert got[i]["mad"] == pytest.approx(statistics.median(abs(x - med) for x in hist))


def test_changepoint(spark):
    got = P.changepoint(series(spark, [71, 72, 70, 71, 71, 62, 61, 63, 62, 62]), ["s"], "i", "v").collect()
    assert len(got) == 1 and got[0]["index"] == 5 and got[0]["magnitude"] == pytest.approx(-9, abs=0.5)
    assert P.changepoint(series(spark, [10] * 8), ["s"], "i", "v").collect() == []
    step = P.changepoint(series(spark, [1, 1, 1, 1, 5, 5, 5, 5]), ["s"], "i", "v").collect()[0]
    assert step["index"] == 4 and math.isinf(step["significance"])


def test_contributions_and_correlations(spark):
    seg = spark.createDataFrame([("g", "a", 10, 52), ("g", "b", 5, 8), ("g", "c", 3, 3)], "g string, k string, b int, a int")
    first = P.segment_contributions(seg, ["g"], "k", "b", "a").where("rank = 1").collect()[0]
    assert first["k"] == "a" and first["share"] == pytest.approx(42 / 45)
    t = spark.createDataFrame([("g", i, float(10 - i)) for i in range(8)], "g string, i int, v double")
    cand = [("g", "up", i, float(i)) for i in range(8)] + [("g", "flat", i, 1.0) for i in range(8)]
    cand += [("g", "gappy", i, None if i % 2 else float(8 - i)) for i in range(8)]
    got = {r["candidate"]: r for r in P.rank_correlations(t, spark.createDataFrame(cand, "g string, candidate string, i int, v double"), ["g"], "i", "v").collect()}
    assert set(got) == {"up", "gappy"}
    assert got["up"]["coefficient"] == pytest.approx(-1) and got["gappy"]["coefficient"] == pytest.approx(1) and got["gappy"]["n"] == 4


def hot(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", i, round(rnd.uniform(0, 50), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i long, v double")


def test_blocked_windows_equal_plain_ones(spark):
    rows, df = hot(spark)
    pos = positions(df, ["k"], ["i"], F.floor(F.col("i") / 37))
    got = {(r["k"], r["i"]): r["pos"] for r in pos.collect()}
    sides = {(r["k"], r["i"]): r for r in side_moments(df, ["k"], "i", "v", "h", block=F.floor(F.col("i") / 37)).collect()}
    prev = {(r["k"], r["i"]): r["prev_v"] for r in with_previous(df, ["k"], ["i"], ["v"], 37).collect()}
    seen = {}
    for k, i, v in rows:
        h = seen.setdefault(k, [])
        assert got[k, i] == len(h) + 1
        assert prev[k, i] == (h[-1] if h else None)
        if h:
            assert sides[k, i]["h_mean"] == pytest.approx(statistics.fmean(h)) and sides[k, i]["h_std"] == pytest.approx(statistics.pstdev(h), abs=1e-9)
        h.append(v)


def test_quantiles_against_brute_force(spark):
    rows, df = hot(spark)
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in {r[0] for r in rows}:
        s = sorted(v for kk, _, v in rows if kk == k)
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            pos = (len(s) - 1) * p
            lo, hi = math.floor(pos), math.ceil(pos)
            assert got[k][name] == pytest.approx(s[lo] + (s[hi] - s[lo]) * (pos - lo))


def trend_of(values):
    z = values[-10:]
    if len(values) < 3:
        return "stable"
    a, b = (functools.reduce(float.__add__, h, 0.0) / len(h) for h in (z[: len(z) // 2], z[len(z) // 2 :]))
    change = (b - a) * 100 / a if a else 0
    return "up" if change > 5 else "down" if change < -5 else "stable"


def same_window(got, win):
    assert got["count"] == len(win)
    if not win:
        assert got["sum"] is None and got["p50"] is None and got["min"] is None
        return
    s = sorted(win)
    assert got["sum"] == pytest.approx(sum(win)) and (got["min"], got["max"]) == (s[0], s[-1]) and got["avg"] == pytest.approx(sum(win) / len(win))
    for name, p in W.PERCENTILES.items():
        assert got[name] == s[max(math.ceil(len(s) * p), 1) - 1]


@pytest.mark.parametrize("per_block, span", [(5, 60_000), (7, 400_000), (16, 2_900_000), (4096, 400_000)])
def test_rolling_window_over_block_borders(spark, per_block, span):
    """Dense and sparse stretches, ties in time and value, one busy and one rare metric; windows of many blocks and of less than one."""
    rnd = random.Random(per_block)
    times = sorted(rnd.choices(range(0, 100_000, 50), k=160) + rnd.choices(range(100_000, 3_000_000), k=140))
    rows = [("busy" if rnd.random() < 0.8 else "rare", t, i, round(rnd.choice([rnd.uniform(-9, 9), rnd.gauss(1000, 1), 5.0]), 2)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "m string, ms long, i long, v double").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["i"]: r for r in W.rolling_aggregate(df, "m", "ts", "v", "i", span, rows_per_block=per_block).collect()}
    assert len(got) == len(rows)
    for j, (m, t, i, _) in enumerate(rows):
        win = [x for n, u, _, x in rows[: j + 1] if n == m and u >= t - span]
        same_window(got[i], win)
        assert got[i]["trend"] == trend_of(win)


def test_rolling_window_with_missing_values_names_and_times(spark):
    rows = [(None, 0, 0, 1.0), (None, 10, 1, None), (None, 20, 2, float("nan")), (None, 5000, 3, 4.0), ("a", None, 4, 1.0), ("a", 7, 5, None), ("a", 9, 6, 2.0)]
    df = spark.createDataFrame(rows, "m string, ms long, i long, v double").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["i"]: r for r in W.rolling_aggregate(df, "m", "ts", "v", "i", 1000, rows_per_block=2).collect()}
    assert set(got) == {0, 1, 2, 3, 5, 6}
    for i, win in ((0, [1.0]), (1, [1.0]), (2, [1.0]), (3, [4.0]), (5, []), (6, [2.0])):
        same_window(got[i], win)
    assert W.rolling_aggregate(df.limit(0), "m", "ts", "v", "i", 1000).count() == 0


@pytest.mark.parametrize("per_block", [6, 25])
def test_long_series_spans_tasks(spark, per_block):
    """One series over many blocks: medians, their distances and quartiles of all earlier values."""
    rnd = random.Random(per_block)
    values = [None if rnd.random() < 0.05 else round(rnd.choice([rnd.gauss(0, 1), rnd.gauss(50, 9), rnd.uniform(-500, 500), 7.0]), 2) for _ in range(500)]
    mad = {r["i"]: r for r in P.anomaly_mad(series(spark, values), ["s"], "i", "v", rows_per_block=per_block).collect()}
    iqr = {r["i"]: r for r in P.anomaly_iqr(series(spark, values), ["s"], "i", "v", rows_per_block=per_block).collect()}
    for i, v in enumerate(values):
        hist = [x for x in values[:i] if x is not None]
        if v is None or len(hist) < 5:
            continue
        med = statistics.median(hist)
        assert mad[i]["median"] == pytest.approx(med) and mad[i]["mad"] == pytest.approx(statistics.median(abs(x - med) for x in hist))
        q = statistics.quantiles(hist, n=4, method="inclusive")
        assert (iqr[i]["q1"], iqr[i]["q3"]) == (pytest.approx(q[0]), pytest.approx(q[2]))


def test_only_slices_of_a_core_are_fetched():
    """Of ten thousand values in a core, ranks that move by ten rows need few."""
    from tallyloom.functions import order_stats as O

    count, least = O.np.full(1000, 10), O.np.arange(1000.0)
    keep, _ = O._chosen(count, least, least + 0.9, 10, O.nearest_rank, [0.5, 0.99], False)
    assert 0 < keep.sum() < 20
    keep, inside = O._chosen(count, least, least + 0.9, 10, O.linear_ranks, [0.5], True)
    assert 0 < keep.sum() < 40 and 4000 < inside < 5000


def test_baseline_continues_from_state(spark):
    rows = [("m", i, float(v), float(v), float(v) + 1) for i, v in enumerate([3, 5, 4, 9, 2, 7, 7, 1])]
    df = spark.createDataFrame(rows, "m string, i long, value double, p50 double, p90 double")
    whole = {r["i"]: (r["points"], r["mean"], r["std_dev"]) for r in Q.update_baseline(df, "m", "i").collect()}
    first = Q.update_baseline(df.where("i < 4"), "m", "i")
    state = first.where("i = 3").select("m", "points", "mean", "std_dev")
    rest = {r["i"]: (r["points"], r["mean"], r["std_dev"]) for r in Q.update_baseline(df.where("i >= 4"), "m", "i", initial=state).collect()}
    for i in range(4, 8):
        assert rest[i] == pytest.approx(whole[i])
    mean = std = n = 0.0
    for i, v in enumerate([3, 5, 4, 9, 2, 7, 7, 1]):  # the online recurrence itself
        mean = (mean * n + v) / (n + 1)
        n += 1
        std = math.sqrt((std**2 * (n - 1) + (v - mean) ** 2) / n)
        assert whole[i] == pytest.approx((n, mean, std))


def test_one_run_day_spans_blocks(spark, make_events):
    """Runs of any density: positions, completion and steps of a runaway run cut into small blocks."""
    from tallyloom.operators import runs as R

    rnd = random.Random(4)
    rows = [{"run_id": "hot" if rnd.random() < 0.8 else f"r{rnd.randrange(3)}", "task_id": "k", "event": rnd.choice(["step_executed"] * 6 + ["human_edited", "task_failed", "task_completed"]),
             "latency_ms": rnd.randrange(1, 90), "timestamp": f"2024-01-01 00:{rnd.randrange(60):02d}:00"} for _ in range(300)]
    ev = make_events(rows)
    want = {}
    for r in sorted(ev.collect(), key=lambda r: (r["timestamp"], r["event_id"])):
        want.setdefault(r["run_id"], []).append(r)
    got = R.trajectories(ev, rows_per_block=16).collect()
    assert len(got) == 300
    for r in got:
        own = want[r["run_id"]]
        assert own[r["pos"] - 1]["event_id"] == r["event_id"]
        assert r["completed"] == ([x["event"] for x in own if x["event"].startswith("task_")][-1:] == ["task_completed"])
    shown = R.waterfall(ev, rows_per_block=16).collect()
    for run, own in want.items():
        listed = [x for x in own if not x["event"].startswith("task_")]
        top = max(x["latency_ms"] for x in listed if x["event"] == "step_executed")
        mine = sorted((r for r in shown if r["run_id"] == run), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(1, len(listed) + 1))
        assert [r["share"] for r in mine] == [pytest.approx(x["latency_ms"] / top) if x["event"] == "step_executed" else 0.0 for x in listed]
        steps = sorted((r["pos"], r["event_id"]) for r in R.run_steps(ev, rows_per_block=16).collect() if r["run_id"] == run and r["kind"] == "human")
        assert steps == [(i + 1, x["event_id"]) for i, x in enumerate(x for x in own if x["event"] == "human_edited")]


def test_correlations_of_many_metrics_against_brute_force(spark):
    """2,000 metrics in many cells, vectors over chunk borders and of differing lengths; pairs that can't pass are dropped early."""
    import numpy as np

    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(40, 24))
    vectors = {}
    for i in range(2000):
        n = int(rnd.choice([24, 24, 24, 17, 11, 9]))
        vectors[f"m{i}"] = (base[i % 40, :n] * rnd.choice([-1, 1]) + rnd.normal(size=n) * rnd.choice([0.01, 2.0])) if i % 7 else np.full(n, 3.0)
    rows = [(m, j, float(v)) for m, x in vectors.items() for j, v in enumerate(x)]
    df = spark.createDataFrame(rows, "m string, t int, v double").repartition(6)
    got = {(r["metric1"], r["metric2"]): r["correlation"] for r in Q.correlated_metrics(df, "m", "t", "v", 0.97, 10, per_cell=300, chunk=7).collect()}
    names = sorted(m for m, x in vectors.items() if len(x) >= 10)
    centred = {m: vectors[m] - vectors[m].mean() for m in names}
    want = {}
    for n in sorted({len(centred[m]) for m in names}):  # all pairs whose shorter vector has n values
        own = [m for m in names if len(centred[m]) >= n]
        x = np.stack([centred[m][:n] for m in own])
        norm = np.sqrt((x * x).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (x @ x.T) / np.outer(norm, norm)
        for i, j in zip(*np.nonzero(np.abs(r) >= 0.97)):
            if own[i] < own[j] and min(len(centred[own[i]]), len(centred[own[j]])) == n:
                want[own[i], own[j]] = r[i, j]
    sure = {p for p, r in want.items() if abs(r) > 0.97 + 1e-9}
    assert len(sure) > 1000 and sure <= set(got) <= set(want) | sure
    assert all(got[p] == pytest.approx(want[p]) for p in got)


def test_hopeless_pairs_are_not_multiplied():
    """What matters comes first: after a chunk or two only the one pair that is left is multiplied."""
    import numpy as np

    rnd = np.random.default_rng(1)
    x, y = (rnd.normal(size=(50, 100)) * np.r_[np.ones(10), np.full(90, 1e-3)] for _ in "xy")
    y[3] = x[7] * 2
    sides = [{f"{s}{i}": v for i, v in enumerate(m)} for s, m in (("a", x), ("b", y))]
    cell = Q._Cell((0, 1), [{m: float((v * v).sum()) for m, v in side.items()} for side in sides], 0.99)
    for c in range(10):
        cell.add([{m: v[10 * c : 10 * c + 10] for m, v in side.items()} for side in sides])
    assert cell.multiplied < 3 * 50 * 50
    assert cell.found() == [("a7", "b3", pytest.approx(1.0))]
