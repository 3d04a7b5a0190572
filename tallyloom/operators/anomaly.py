"""Baseline-driven anomaly detection over rolled-up metric readings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.blocks import block_of, numbered
from tallyloom.plans.session import written

MIN_POINTS = 10
SENSITIVITY = 0.7


def update_baseline(rolled: DataFrame, name: str, order: str, block: Column | None = None,
                    initial: DataFrame | None = None) -> DataFrame:
    """The baseline after each reading, from ``rolled`` (value, p50, p90).

    ``initial`` continues earlier baselines: (name, points, mean, std_dev), one
    row per metric.

    The online recurrence of the deviation is a running sum of squared
    distances to the running mean, so it is two blocked running aggregates and
    no fold over rows: ``mean_n`` is the mean so far, ``std_n`` is
    ``sqrt(sum (v_i - mean_i)^2 / n)``.
    """
    # The readings come from a costly plan and are read once for the blocks' sums and once for the rows.
    rows = written(rolled.withColumn("_block", block if block is not None else block_of(rolled, order)), "rolled")
    zero = F.lit(0.0)
    so_far = Window.partitionBy(name, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(name, "_block").agg(F.count("value").alias("_n"), F.sum("value").alias("_s"))
    mean = _continued(rows, blocks, name, {"_n": F.count("value").over(so_far), "_s": F.sum("value").over(so_far)})
    if initial is None:
        mean = mean.withColumns({"_n0": F.lit(0).cast("long"), "_m0": zero, "_s0": zero})
    else:
        past = initial.select(F.col(name).alias("_name"), F.col("points").alias("_p"), F.col("mean").alias("_m"), F.col("std_dev").alias("_d"))
        mean = mean.join(past, F.col(name).eqNullSafe(F.col("_name")), "left").withColumns({
            "_n0": F.coalesce("_p", F.lit(0).cast("long")), "_m0": F.coalesce(F.col("_p") * F.col("_m"), zero),
            "_s0": F.coalesce(F.col("_p") * F.col("_d") * F.col("_d"), zero)})
    n = F.col("_n0") + F.col("_n")
    mean = mean.select(*rows.columns, "_s0", n.alias("points"), F.try_divide(F.col("_m0") + F.coalesce("_s", zero), n.cast("double")).alias("mean"))
    mean = written(mean.withColumn("_sq", (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))), "means")
    squares = mean.groupBy(name, "_block").agg(F.sum("_sq").alias("_q"))
    s = _continued(mean, squares, name, {"_q": F.sum("_sq").over(so_far)})
    cols, total = rolled.columns, F.col("_s0") + F.coalesce("_q", zero)
    half = (F.col("p90") - F.col("p50")) / 2
    return s.select(
        *cols, "points", "mean", F.sqrt(F.greatest(total, zero) / F.col("points")).alias("std_dev"),
        F.col("p50").alias("median"), (F.col("p50") - half).alias("q1"), F.col("p90").alias("q3"),
        (F.col("p90") - (F.col("p50") - half)).alias("iqr"),
        (F.abs(F.col("value") - F.col("p50")) * 1.4826).alias("mad"))


def _continued(rows: DataFrame, blocks: DataFrame, name: str, local: dict[str, Column]) -> DataFrame:
    """Running sums inside blocks, continued with the sums of all earlier blocks of the metric."""
    before = Window.partitionBy(name).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(F.col(name).alias("_of"), F.col("_block").alias("_in"), *[F.sum(c).over(before).alias(f"_before{c}") for c in local])
    both = rows.withColumns(local).join(carry, F.col(name).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_in")))
    return both.withColumns({c: F.coalesce(f"_before{c}", F.lit(0)) + F.col(c) for c in local}).drop("_of", "_in", *[f"_before{c}" for c in local])


def _capped(x: Column, den: Column) -> Column:
    """min(x / den, 1); a zero denominator gives 1 for a positive x and NULL for 0/0."""
    return F.when(den == 0, F.when(x > 0, 1.0)).otherwise(F.least(F.try_divide(x, den), F.lit(1.0)))


def detect_statistical() -> dict[str, Column]:
    v, mu, sd = F.col("value"), F.col("mean"), F.col("std_dev")
    lo, hi = mu - 3 * sd, mu + 3 * sd
    return {"hit": (v < lo) | (v > hi), "confidence": _capped(F.abs(v - mu), sd * 3), "lo": lo, "hi": hi}


def detect_z() -> dict[str, Column]:
    v, mu, sd = F.col("value"), F.col("mean"), F.col("std_dev")
    t = 2.5
    return {"hit": F.abs(v - mu) > t * sd, "confidence": _capped(F.abs(v - mu), sd * t), "lo": mu - t * sd, "hi": mu + t * sd}


def detect_mad() -> dict[str, Column]:
    v, med, mad = F.col("value"), F.col("median"), F.col("mad")
    z = 0.6745 * F.abs(v - med)
    return {"hit": z > 3 * mad, "confidence": _capped(z, mad * 3), "lo": med - 3 * mad / 0.6745, "hi": med + 3 * mad / 0.6745}


def detect_iqr() -> dict[str, Column]:
    v, width = F.col("value"), F.col("iqr")
    lo, hi = F.col("q1") - 1.5 * width, F.col("q3") + 1.5 * width
    dist = F.when(v < lo, lo - v).when(v > hi, v - hi).otherwise(0.0)
    return {"hit": (v < lo) | (v > hi), "confidence": F.coalesce(_capped(dist, width), F.lit(0.0)), "lo": lo, "hi": hi}


def detect_pattern() -> dict[str, Column]:
    v, rate, trend = F.col("value"), F.col("rate"), F.col("trend")
    hit = ((trend == "up") & (rate > 0) & (rate > v * 0.5)) | ((trend == "down") & (rate != 0) & (F.abs(rate) > v * 0.5))
    hit = F.coalesce(hit, F.lit(False))
    return {"hit": hit, "confidence": F.when(hit, 0.8).otherwise(0.0), "lo": F.lit(0.0), "hi": F.lit(0.0)}


DETECTORS = {"statistical": detect_statistical, "zscore": detect_z, "mad": detect_mad, "iqr": detect_iqr, "pattern": detect_pattern}


def severity(value: Column, lo: Column, hi: Column, confidence: Column) -> Column:
    width = hi - lo
    far = F.greatest(F.try_divide(value - hi, width), F.try_divide(lo - value, width))
    return (F.when((far > 2) & (confidence > 0.9), "critical").when((far > 1.5) & (confidence > 0.8), "high")
            .when((far > 1) & (confidence > 0.7), "medium").otherwise("low"))


def alert_severity(sev: Column) -> Column:
    return F.when(sev == "critical", "critical").when(sev == "high", "error").when(sev == "medium", "warning").otherwise("info")


def judge(baselined: DataFrame, name: str, order: str, methods: Sequence[str] = tuple(DETECTORS)) -> DataFrame:
    """Every reading under every method: hit or not, confidence and expected range."""
    unknown = [m for m in methods if m not in DETECTORS]
    if unknown:
        raise ValueError(f"unknown detection methods: {unknown}")
    tests = []
    for m in methods:
        d = DETECTORS[m]()
        tests.append(F.struct(
            F.lit(m).alias("method"), F.coalesce(d["hit"], F.lit(False)).alias("hit"), d["confidence"].cast("double").alias("confidence"),
            d["lo"].cast("double").alias("lo"), d["hi"].cast("double").alias("hi")))
    return baselined.select(name, order, "value", "points", F.inline(F.array(*tests)))


def detect(baselined: DataFrame, name: str, order: str, methods: Sequence[str] = tuple(DETECTORS), sensitivity: float = SENSITIVITY,
           gated: bool = True) -> DataFrame:
    """One row per anomaly and method: range, confidence, severity, description, alert severity.

    Gated: at least ten points in the baseline and confidence >= 1 - sensitivity.
    """
    out = judge(baselined, name, order, methods).where(F.col("hit"))
    if gated:
        out = out.where((F.col("points") >= MIN_POINTS) & (F.col("confidence") >= 1 - sensitivity))
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    off = F.abs(F.try_divide(v - (hi + lo) / 2, (hi - lo) / 2) * 100)
    side = F.when(v > hi, "above").otherwise("below")
    sev = severity(v, lo, hi, F.col("confidence"))
    text = F.concat(F.col(name), F.lit(" is "), F.coalesce(F.format_string("%.1f", off), F.lit("inf")), F.lit("% "), side,
                    F.lit(" the expected range by "), F.col("method"), F.lit(" detection"))
    return out.select(name, order, "value", "method", "confidence", "lo", "hi", sev.alias("severity"),
                      text.alias("description"), alert_severity(sev).alias("alert_severity"))


#: Metrics a cell of the correlation grid holds, and readings of each that meet at a time.
METRICS_PER_CELL, READINGS_PER_CHUNK = 512, 4096


def _aligned(df: DataFrame, name: str, ts: str, value: str, min_points: int, chunk: int) -> DataFrame:
    """Chunks of the centred readings of each metric: metric, chunk, x (at most ``chunk`` values), n and norm of the whole vector.

    Positions come from blocks cut by counts, so a busy metric spans tasks. Two
    vectors meet as far as the shorter one goes, so nothing beyond the second
    longest can matter.
    """
    rows = df.select(F.col(name).alias("metric"), F.col(ts).alias("_ts"), F.col(value).cast("double").alias("_v"))
    rows = numbered(rows, ["metric"], ["_ts"])
    stats = rows.groupBy("metric").agg(F.avg("_v").alias("_mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)
    stats = written(stats, "metrics")
    longest = [r["n"] for r in stats.orderBy(F.desc("n")).limit(2).collect()]
    placed = rows.where(F.col("pos") <= (longest[1] if len(longest) == 2 else 0)).join(stats, "metric")
    x = F.struct("pos", (F.col("_v") - F.col("_mean")).alias("x"))
    chunks = placed.groupBy("metric", "n", F.floor((F.col("pos") - 1) / chunk).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(x)), lambda s: s["x"]).alias("x"))
    return written(chunks, "chunks")


class _Cell:
    """Products of two cells of metrics, chunk by chunk, until no pair can reach the threshold any more."""

    def __init__(self, key, norms, threshold: float):
        self.key, self.threshold = key, threshold
        self.names = [sorted(n) for n in norms]
        self.norms = [np.array([d[m] for m in names]) for d, names in zip(norms, self.names)]
        shape = len(self.names[0]), len(self.names[1])
        self.dot, self.nx, self.ny = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.alive = np.ones(shape, bool)
        if key[0] == key[1]:
            self.alive &= np.arange(shape[0])[:, None] < np.arange(shape[1])[None, :]
        self.multiplied = 0

    def add(self, sides) -> None:
        """One chunk: per side a dict of metric to its values there; a metric that has ended is not in it."""
        rows = [np.array([i for i, m in enumerate(names) if m in have and self.alive.any(axis=1 - side)[i]], dtype=int) for side, (names, have) in enumerate(zip(self.names, sides))]
        if not len(rows[0]) or not len(rows[1]):
            return
        values = [[have[self.names[side][i]] for i in rows[side]] for side, have in enumerate(sides)]
        sizes = [np.array([len(v) for v in part]) for part in values]
        width = int(max(sizes[0].max(), sizes[1].max()))
        x, y = (np.stack([np.pad(v, (0, width - len(v))) for v in part]) for part in values)
        at = np.ix_(*rows)
        self.multiplied += x.shape[0] * y.shape[0]
        self.dot[at] += x @ y.T
        upto = [np.pad(np.cumsum(m * m, axis=1), ((0, 0), (1, 0))) for m in (x, y)]
        self.nx[at] += upto[0][:, sizes[1]]
        self.ny[at] += upto[1][:, sizes[0]].T
        # what is still to come adds at most the product of the norms that are left
        with np.errstate(divide="ignore", invalid="ignore"):
            so_far = np.abs(self.dot) / np.sqrt(self.nx * self.ny)
            left = [np.sqrt(np.maximum(1 - n / whole, 0)) for n, whole in ((self.nx, self.norms[0][:, None]), (self.ny, self.norms[1][None, :]))]
            self.alive &= ~(so_far + left[0] * left[1] < self.threshold - 1e-9)

    def found(self) -> list[tuple]:
        den = np.sqrt(self.nx * self.ny)
        r = np.divide(self.dot, den, out=np.zeros_like(den), where=den > 0)
        i, j = np.nonzero(self.alive & (np.abs(r) >= self.threshold))
        pairs = [(self.names[0][a], self.names[1][b], float(r[a, b])) for a, b in zip(i, j)]
        return [(min(m, n), max(m, n), c) for m, n, c in pairs]


def correlated_metrics(df: DataFrame, name: str, ts: str, value: str, threshold: float = 0.7, min_points: int = 10,
                       per_cell: int = METRICS_PER_CELL, chunk: int = READINGS_PER_CHUNK) -> DataFrame:
    """Pairs of metrics whose recent readings correlate with |r| >= threshold.

    ``df`` holds the readings of the look-back window, all of which count.
    Readings are aligned by position, as far as the shorter metric goes, and
    centred on each metric's own mean. The pairs are a blocked matrix product:
    metrics are dealt to as many cells as their number asks for, and a task
    multiplies two cells chunk by chunk, holding one chunk of each. Pairs whose
    remaining norms can't lift them over the threshold are left out of the
    following products. Metrics without a name are left out.
    """
    chunks = _aligned(df.where(F.col(name).isNotNull()), name, ts, value, min_points, chunk)
    norms = chunks.groupBy("metric").agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm"))
    cells = max(1, -(-norms.count() // per_cell))
    dealt = written(norms.withColumn("cell", F.pmod(F.xxhash64("metric"), F.lit(cells)).cast("int")), "norms")

    def to_pairs(rows: DataFrame) -> DataFrame:
        """Each row to all pairs of cells that its own takes part in."""
        other = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        return other.select("*", F.least("cell", "o").alias("a"), F.greatest("cell", "o").alias("b")).drop("o")

    # a pair of cells gets its metrics' norms first (chunk -1), then their chunks in order
    head = dealt.select("cell", "metric", F.lit(-1).cast("long").alias("chunk"), F.array("norm").alias("x"))
    body = chunks.join(dealt.select("metric", "cell"), "metric").select("cell", "metric", "chunk", "x")
    sent = to_pairs(head.unionByName(body)).repartition("a", "b").sortWithinPartitions("a", "b", "chunk")

    def run(batches):
        cell, at, sides = None, None, ({}, {})
        done: list[tuple] = []

        def close():
            nonlocal cell
            if at is None:
                return
            if at[2] == -1:
                cell = _Cell(at[:2], [{m: v[0] for m, v in side.items()} for side in sides], threshold)
            else:
                cell.add(sides)

        for batch in batches:
            a, b, c, own, metric = (batch.column(k).to_pylist() for k in ("a", "b", "chunk", "cell", "metric"))
            lists = batch.column("x")
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                key = (a[i], b[i], c[i])
                if key != at:
                    close()
                    if at is not None and key[:2] != at[:2]:
                        done += cell.found()
                    at, sides = key, ({}, {})
                values = flat[starts[i] : starts[i + 1]].copy()
                for side in (0, 1):
                    if own[i] == key[side]:
                        sides[side][metric[i]] = values
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(("metric1", "metric2", "correlation"), map(list, zip(*done)))))
                done = []
        close()
        if cell is not None:
            done += cell.found()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("metric1", "metric2", "correlation"), map(list, zip(*done)))))

    return sent.mapInArrow(run, "metric1 string, metric2 string, correlation double")


def correlation_breaks(pairs: DataFrame, current: DataFrame, name: str = "metric", limit: float = 0.3) -> DataFrame:
    """Correlated pairs whose value ratio departs from their baseline ratio.

    ``current`` holds the latest (metric, value, mean) of each metric.
    """
    side = lambda i: current.select(F.col(name).alias(f"metric{i}"), F.col("value").alias(f"v{i}"), F.col("mean").alias(f"m{i}"))
    j = pairs.join(side(1), "metric1").join(side(2), "metric2")
    expected, actual = F.try_divide(F.col("m1"), F.col("m2")), F.try_divide(F.col("v1"), F.col("v2"))
    j = j.withColumn("expected", expected).withColumn("actual", actual)
    dev = F.try_divide(F.abs(F.col("actual") - F.col("expected")), F.col("expected"))
    return j.withColumn("deviation", dev).where(F.col("deviation") > limit).select(
        "metric1", "metric2", F.col("actual").alias("value"), (F.col("expected") * 0.7).alias("lo"), (F.col("expected") * 1.3).alias("hi"),
        F.when(F.col("deviation") > 0.5, "high").otherwise("medium").alias("severity"),
        F.least(F.col("deviation"), F.lit(1.0)).alias("confidence"))


def health_score(anomalies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """100 minus 20, 10 and 2 per critical, high and other anomaly, never below 0. Takes the last hour's anomalies."""
    s = F.col("severity")
    critical, high, n = F.count_if(s == "critical"), F.count_if(s == "high"), F.count(F.lit(1))
    score = F.lit(100) - critical * 20 - high * 10 - (n - critical - high) * 2
    return anomalies.groupBy(*by).agg(
        F.greatest(F.lit(0).cast("long"), score).alias("score"), n.alias("anomalies"), critical.alias("critical"),
        F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("confidence"))
