"""Exact order statistics of sliding and expanding windows, for groups of any size.

Rows are cut in blocks by counts (``blocks.cut``). The window of a row is then
an edge (part of the block where the window starts), a core (whole blocks) and
the row's own block up to the row. All rows of a block whose windows start in
one block share a core, and only their edge and own rows differ. A wanted rank
can therefore move by no more than these rows, so of the core only the values
near that rank matter. Histograms of value ranges per block, added up along the
blocks, tell where they are; only those ranges are fetched, as counts per value.
No row holds an array and no task holds a window: a task gets two blocks and
some slices of the core.

- ``sliding`` gives trailing windows of a fixed time span.
- ``expanding`` gives all earlier rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.blocks import ROWS_PER_BLOCK, cut
from tallyloom.functions.quantiles import value_range
from tallyloom.plans.session import written

EDGE, OWN, TAIL, CORE, FACTS = 1, 2, 3, 4, 0
TAIL_ROWS = 9


def nearest_rank(n: int, p: float) -> tuple[int, int]:
    """The one rank (from 1) of a nearest-rank percentile, as a range."""
    r = max(math.ceil(n * p), 1)
    return r, r


def linear_ranks(n: int, p: float) -> tuple[int, int]:
    """The two ranks (from 1) between which a linear quantile lies."""
    pos = (n - 1) * p
    return math.floor(pos) + 1, min(math.ceil(pos) + 1, n)


def _chosen(count: np.ndarray, least: np.ndarray, most: np.ndarray, moving: int, ranks, probs, spread: bool) -> tuple[np.ndarray, int]:
    """Which value ranges of a core the ranks can lie in, and how many values lie, for ``spread``, surely nearer to the median than the wanted distances."""
    upto = np.cumsum(count)
    before, n = upto - count, int(upto[-1])
    keep = np.zeros(len(count), bool)

    def add(p):
        low, high = ranks(max(n, 1), p)[0] - moving, ranks(n + moving, p)[1]
        found = (upto >= low) & (before < high)
        keep[found] = True
        return found

    for p in probs:
        add(p)
    if not spread:
        return keep, 0
    middle = add(0.5)
    if ranks(max(n, 1), 0.5)[0] - moving < 1 or ranks(n + moving, 0.5)[1] > n:  # the core alone bounds no median
        return np.ones(len(count), bool), 0
    low, high = least[middle].min(), most[middle].max()  # the median of every window of the group lies between
    # the distances to try: those of the ends of ranges
    steps = np.unique(np.abs(np.concatenate([least - low, least - high, most - low, most - high])))

    def surely(d):  # values within d of any median
        return int(count[(least >= high - d) & (most <= low + d)].sum())

    def maybe(d):  # values within d of some median
        return int(count[(most >= low - d) & (least <= high + d)].sum())

    near, far = (n - 1) // 2, (n + moving) // 2 + 1
    a = bisect_left(steps, True, key=lambda d: maybe(d) + moving > near) - 1
    b = bisect_left(steps, True, key=lambda d: surely(d) >= far)
    at_least = steps[a] if a >= 0 else 0.0
    at_most = steps[b] if b < len(steps) else np.inf
    left = (most >= low - at_most) & (least <= high - at_least)
    right = (most >= low + at_least) & (least <= high + at_most)
    keep |= left | right
    inside = ~keep & (least > high - at_least) & (most < low + at_least)
    return keep, int(count[inside].sum())


def _core_values(rows: DataFrame, needs: DataFrame, ranks: Callable, probs: Sequence[float], spread: bool) -> DataFrame:
    """The values of each group's core near the wanted ranks: value, how often, its range and how many core values lie below the range."""
    own = needs.where(F.col("_kind") == OWN)
    runs = own.where("_facts.last").select("_key", "_block", F.col("_b").alias("_ord"))
    cores = own.where("_b - 1 > _c").withColumn("_moving", F.col("_facts.moving"))
    values = (
        rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("_key", "_block", value_range(F.col("value")).alias("_range"), "value").agg(F.count(F.lit(1)).alias("_times"))
    )
    along = Window.partitionBy("_key", "_range").orderBy("_ord")
    last = runs.groupBy("_key").agg(F.max("_ord").alias("_last"))
    upto = (
        values.groupBy("_key", "_block", "_range").agg(F.sum("_times").alias("_n"))
        .join(runs.select("_key", "_block", "_ord"), ["_key", "_block"]).join(last, "_key")
        .withColumn("_upto", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_next", F.coalesce(F.lead("_ord").over(along) - 1, "_last"))
        .select("_key", "_range", "_upto", F.explode(F.sequence("_ord", "_next")).alias("_at"))
    )
    ends = cores.select("_key", "_b", "_c", "_moving", F.inline(F.array(
        F.struct((F.col("_b") - 1).alias("_at"), F.lit(1).alias("_sign")), F.struct(F.col("_c").alias("_at"), F.lit(-1).alias("_sign")))))
    within = values.groupBy("_key", "_range").agg(F.min("value").alias("_least"), F.max("value").alias("_most"))
    counts = (
        ends.join(upto, ["_key", "_at"]).groupBy("_key", "_b", "_c", "_range")
        .agg(F.sum(F.col("_sign") * F.col("_upto")).alias("_n"), F.first("_moving").alias("_moving")).where("_n > 0").join(within, ["_key", "_range"])
    )

    def choose(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_range", "ascending")]))
        count, least, most = (table.column(c).to_numpy() for c in ("_n", "_least", "_most"))
        keep, inside = _chosen(count, least, most, table.column("_moving")[0].as_py(), ranks, probs, spread)
        below = np.cumsum(count) - count
        at = pa.array(np.flatnonzero(keep))
        picked = table.select(["_key", "_b", "_c", "_range"]).take(at)
        return picked.append_column("_below", pa.array(below[keep], pa.int64())).append_column("_inside", pa.array([inside] * len(at), pa.int64()))

    kind = rows.select("_key").schema["_key"].dataType.simpleString()
    slices = counts.groupBy("_key", "_b", "_c").applyInArrow(choose, f"_key {kind}, _b int, _c int, _range long, _below long, _inside long")
    blocks = runs.select("_key", "_block", F.col("_ord").alias("_at"))
    return (
        slices.withColumn("_at", F.explode(F.sequence(F.col("_c") + 1, F.col("_b") - 1))).join(blocks, ["_key", "_at"])
        .join(values, ["_key", "_block", "_range"]).groupBy("_key", "_b", "_c", "_range", "_below", "_inside", "value").agg(F.sum("_times").alias("_times"))
    )


class Sorted:
    """The values of a window in order: a list of what moves and the fetched slices of its core."""

    def __init__(self, core_n: int, moving: int, values: np.ndarray, times: np.ndarray, below: np.ndarray, inside: int):
        order = np.argsort(values, kind="stable")
        values, times, below = values[order], times[order], below[order]
        self.core_n, self.moving, self.inside = core_n, moving, inside
        self.list = np.repeat(values, times).tolist()
        starts, first = np.unique(below, return_index=True)  # one per fetched range
        listed = np.cumsum(times) - times
        self.ends = starts + np.add.reduceat(times, first) if len(first) else starts
        self.left_out = starts - listed[first]
        self.offsets: dict[float, int] = {}

    def offset(self, ranks, p: float) -> int:
        """How many core values below the wanted rank are not in the list."""
        if p not in self.offsets:
            low = ranks(max(self.core_n, 1), p)[0] - self.moving
            at = int(np.searchsorted(self.ends, low))
            self.offsets[p] = int(self.left_out[at]) if at < len(self.ends) else 0
        return self.offsets[p]

    def add(self, value: float) -> None:
        insort(self.list, value)

    def drop(self, value: float) -> None:
        del self.list[bisect_left(self.list, value)]

    def at(self, ranks, n: int, p: float) -> tuple[float, float]:
        skip = self.offset(ranks, p)
        low, high = ranks(n, p)
        return self.list[low - 1 - skip], self.list[high - 1 - skip]

    def distance(self, middle: float, k: int) -> float:
        """k-th smallest (from 0) distance of the window's values to ``middle``, by bisection on the run of nearest values."""
        s, k = self.list, k - self.inside
        lo, hi = 0, len(s) - k - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if middle - s[mid] > s[mid + k + 1] - middle:
                lo = mid + 1
            else:
                hi = mid
        return max(middle - s[lo], s[lo + k] - middle)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(float)  # null becomes NaN


def _sorted_of(table: pa.Table, kinds: np.ndarray, moving: int, core_n: int) -> Sorted:
    core = table.filter(pa.array(kinds == CORE))
    inside = core.column("_inside")[0].as_py() if core.num_rows else 0
    ints = [core.column(c).to_numpy().astype(np.int64) for c in ("_times", "_below")]
    return Sorted(core_n, moving, _floats(core.column("value")), *ints, inside)


def _groups_of(runs: pa.Table, span_us: int | None) -> pa.Table:
    """From the blocks of one series: which rows of which blocks each group of windows needs, and what its core adds up to.

    A group is an own block (number ``_b``, from 1) with the block in which its
    windows start (``_c``; 0 where windows hold all earlier rows).
    """
    runs = runs.take(pc.sort_indices(runs, [("_block", "ascending")]))
    block, rows, end, n = (runs.column(c).to_numpy() for c in ("_block", "_rows", "_end", "_n"))
    total, least, most = (_floats(runs.column(c)) for c in ("_sum", "_min", "_max"))
    lo, hi = runs.column("_lo").to_numpy(), runs.column("_hi").to_numpy()
    upto = np.concatenate([[0], np.cumsum(n)])
    needs: list[tuple] = []
    for b in range(1, len(block) + 1):
        starts = [0] if span_us is None else range(1 + int(np.searchsorted(hi, lo[b - 1] - span_us)), 2 + int(np.searchsorted(hi, hi[b - 1] - span_us)))
        for c in starts:
            since = -FAR if c <= 1 else int(hi[c - 2]) + span_us + 1
            to = FAR if c == starts[-1] else int(hi[c - 1]) + span_us
            core = slice(c, b - 1)
            inside = c < b - 1 and int(upto[b - 1] - upto[c])
            moving = int(rows[b - 1] + (rows[c - 1] if 0 < c < b else 0))
            fact = {"since": since, "to": to, "moving": moving, "last": c == starts[-1], "n": inside or 0}
            fact |= {k: float(f(v[core])) if inside else None for k, f, v in (("sum", np.nansum, total), ("min", np.nanmin, least), ("max", np.nanmax, most))}
            needs.append((block[b - 1], b, c, OWN, -FAR, -1, fact))
            if span_us is None:
                continue
            if c < b:
                needs.append((block[c - 1], b, c, EDGE, max(int(lo[b - 1]), since) - span_us, -1, None))
            missing, k = TAIL_ROWS, b - 1  # the nine rows before the block, out of as many blocks as hold them
            while missing > 0 and k > 0:
                needs.append((block[k - 1], b, c, TAIL, -FAR, int(end[k - 1]) - missing, None))
                missing, k = missing - int(rows[k - 1]), k - 1
    key = runs.column("_key").take(pa.array([0] * len(needs)))
    return pa.Table.from_arrays([key, *(pa.array(v, t) for v, t in zip(zip(*needs), NEED_TYPES))], ["_key", *NEEDS])


FAR = 2**62
NEEDS = ("_block", "_b", "_c", "_kind", "_since", "_after", "_facts")
NEED_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.struct([
    ("since", pa.int64()), ("to", pa.int64()), ("moving", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), ("sum", pa.float64()), ("min", pa.float64()), ("max", pa.float64())]))
NEED_DDL = "_block long, _b int, _c int, _kind int, _since long, _after long, _facts struct<since:long,to:long,moving:long,last:boolean,n:long,sum:double,min:double,max:double>"


def _planned(rows: DataFrame, span_us: int | None) -> DataFrame:
    """The needs of all groups. Blocks are summed up where they lie; a task then gets one row per block of a series."""
    v = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    runs = rows.groupBy("_key", "_block").agg(
        F.count(v).alias("_n"), F.count(F.lit(1)).alias("_rows"), F.sum(v).alias("_sum"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.max("_pos").alias("_end"),
        F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    kind = rows.schema["_key"].dataType.simpleString()
    return written(runs.groupBy("_key").applyInArrow(lambda t: _groups_of(t, span_us), f"_key {kind}, {NEED_DDL}"), "groups")


def _sent(rows: DataFrame, needs: DataFrame, core: DataFrame | None) -> DataFrame:
    """What each group gets: its rows by kind, its facts and its slices of the core."""
    n = needs.select(F.col("_key").alias("_for"), F.col("_block").alias("_in"), "_b", "_c", "_kind", "_since", "_after")
    moved = rows.join(n, (F.col("_key") == F.col("_for")) & (F.col("_block") == F.col("_in")) & (F.col("_us") >= F.col("_since")) & (F.col("_pos") > F.col("_after")))
    moved = moved.drop("_for", "_in", "_since", "_after", "_block")
    facts = needs.where(F.col("_kind") == OWN).select("_key", "_b", "_c", F.lit(FACTS).alias("_kind"), "_facts")
    out = moved.unionByName(facts, allowMissingColumns=True)
    if core is not None:
        return out.unionByName(core.drop("_range").withColumn("_kind", F.lit(CORE)), allowMissingColumns=True)
    return out.withColumns({c: F.lit(None).cast("long") for c in ("_below", "_inside", "_times")})


def sliding(df: DataFrame, keys: Sequence[str], ts_us: str, order: Sequence[str], value: str, span_us: int, probs: dict[str, float],
            rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """After each row, the window of the last ``span_us`` up to it: count, sum, min, max, nearest-rank percentiles and the last ten values.

    ``ts_us`` is the time in microseconds, ``order`` orders rows of one time.
    Missing values (null, NaN) count in no window, their rows get the window's
    results like any other. Rows without a time are left out. Columns of ``df``
    stay, with ``value`` as a double beside them.
    """
    rows = df.where(F.col(ts_us).isNotNull()).withColumns({"_us": F.col(ts_us), "value": F.col(value).cast("double")})
    rows = cut(rows, keys, ["_us", *order], rows_per_block)
    needs = _planned(rows, span_us)
    sent = _sent(rows, needs, _core_values(rows, needs, nearest_rank, list(probs.values()), False) if probs else None)
    columns = [*df.columns, *(["value"] if "value" not in df.columns else [])]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_pos", "ascending")]))
        kinds = table.column("_kind").to_numpy()
        fact = table.column("_facts").filter(pa.array(kinds == FACTS))[0].as_py()
        mine, edge, tail = (table.filter(pa.array(kinds == k)) for k in (OWN, EDGE, TAIL))
        us, e_us = mine.column("_us").to_numpy(), edge.column("_us").to_numpy()
        values, e_values = _floats(mine.column("value")), _floats(edge.column("value"))
        n, total = fact["n"], fact["sum"] or 0.0
        skip, ends = int((us < fact["since"]).sum()), int((us <= fact["to"]).sum())
        since = us - span_us
        gone, first = np.searchsorted(e_us, since), np.searchsorted(us, since)  # the edge's and the own block's rows before each window
        # sums run from the end of the edge and from the start of the own block, so nothing large is taken away again
        known, e_known = ~np.isnan(values), ~np.isnan(e_values)
        here = slice(skip, ends)

        def over(own: np.ndarray, edge: np.ndarray) -> np.ndarray:
            upto, after = np.concatenate([[0], np.cumsum(own)]), np.append(np.cumsum(edge[::-1])[::-1], 0)
            return (after[gone] + (upto[1:] - upto[first]))[here]

        count = n + over(known.astype(np.int64), e_known.astype(np.int64))
        sums = total + over(np.where(known, values, 0.0), np.where(e_known, e_values, 0.0))
        window = _sorted_of(table, kinds, fact["moving"], n)
        for v in e_values[e_known].tolist():
            window.add(v)
        wanted = [(np.maximum(np.ceil(count * p), 1).astype(np.int64) - 1 - window.offset(nearest_rank, p)).tolist() for p in probs.values()]
        found: list[list] = [[] for _ in ("min", "max", *probs)]
        numbers, e_numbers, starts, e_starts = values.tolist(), e_values.tolist(), first.tolist(), gone.tolist()
        least, most = (math.inf, -math.inf) if fact["min"] is None else (fact["min"], fact["max"])
        a = e = 0
        for i in range(ends):
            if numbers[i] == numbers[i]:
                window.add(numbers[i])
            if i < skip:
                continue
            while e < e_starts[i]:
                if e_numbers[e] == e_numbers[e]:
                    window.drop(e_numbers[e])
                e += 1
            while a < starts[i]:
                if numbers[a] == numbers[a]:
                    window.drop(numbers[a])
                a += 1
            s = window.list
            if count[i - skip]:
                found[0].append(min(least, s[0]) if s else least)
                found[1].append(max(most, s[-1]) if s else most)
                for out, at in zip(found[2:], wanted):
                    out.append(s[at[i - skip]])
            else:
                for out in found:
                    out.append(None)
        made = mine.select(columns).slice(skip, ends - skip)
        for c, v in zip(("min", "max", *probs), found):
            made = made.append_column(f"_{c}", pa.array(v, pa.float64()))
        made = made.append_column("_count", pa.array(count, pa.int32())).append_column("_sum", pa.array(sums, pa.float64(), mask=count == 0))
        return made.append_column("_recent", _last_ten(tail, us, values, since, here))

    fields = {c: rows.schema[c].dataType.simpleString() for c in columns} | {f"_{c}": "double" for c in ("min", "max", *probs)}
    fields |= {"_count": "int", "_sum": "double", "_recent": "array<double>"}
    return sent.groupBy("_key", "_b", "_c").applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in fields.items()))


def _last_ten(tail: pa.Table, us: np.ndarray, values: np.ndarray, since: np.ndarray, here: slice) -> pa.Array:
    """Of each row in ``here``, the window's values among the last ten rows of its series; ``tail`` has the rows before the block."""
    all_us, all_values = np.concatenate([tail.column("_us").to_numpy(), us]), np.concatenate([_floats(tail.column("value")), values])
    end = (np.arange(len(us)) + tail.num_rows + 1)[here]
    start = np.maximum(end - TAIL_ROWS - 1, np.searchsorted(all_us, since[here]))
    size = end - start
    borders = np.concatenate([[0], np.cumsum(size)])
    taken = all_values[np.repeat(start - borders[:-1], size) + np.arange(borders[-1])]
    known = ~np.isnan(taken)
    offsets = np.concatenate([[0], np.cumsum(known)])[borders]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(taken[known], pa.float64()))


def expanding(df: DataFrame, keys: Sequence[str], order: str, value: str, quantiles: dict[str, float], mad: bool = False,
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Before each row, the values of all earlier rows of its group: their number, linear quantiles and the median distance to their median.

    Missing values (null, NaN) are no values, their rows get results like any
    other; without earlier values these are null. Adds ``h_n``, ``h_<name>`` and
    ``h_mad`` to the columns of ``df``.
    """
    rows = cut(df.withColumns({"_us": F.lit(0).cast("long"), "value": F.col(value).cast("double")}), keys, [order], rows_per_block)
    needs = _planned(rows, None)
    probs = sorted({*quantiles.values(), *([0.5] if mad else [])})
    sent = _sent(rows, needs, _core_values(rows, needs, linear_ranks, probs, mad))
    columns = df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_pos", "ascending")]))
        kinds = table.column("_kind").to_numpy()
        fact = table.column("_facts").filter(pa.array(kinds == FACTS))[0].as_py()
        mine = table.filter(pa.array(kinds == OWN))
        window = _sorted_of(table, kinds, fact["moving"], fact["n"])
        n = fact["n"]
        got: dict[str, list] = {c: [] for c in ("n", *quantiles, *(["mad"] if mad else []))}
        for v in _floats(mine.column("value")).tolist():
            got["n"].append(n)
            at = {p: window.at(linear_ranks, n, p) if n else None for p in probs}
            for name, p in quantiles.items():
                pos = (n - 1) * p
                got[name].append(at[p][0] + (at[p][1] - at[p][0]) * (pos - math.floor(pos)) if n else None)
            if mad:
                middle = (at[0.5][0] + at[0.5][1]) / 2 if n else 0.0
                got["mad"].append((window.distance(middle, (n - 1) // 2) + window.distance(middle, n // 2)) / 2 if n else None)
            if not math.isnan(v):
                window.add(v)
                n += 1
        made = mine.select(columns)
        for c, found in got.items():
            made = made.append_column(f"h_{c}", pa.array(found, pa.int64() if c == "n" else pa.float64()))
        return made

    fields = {c: rows.schema[c].dataType.simpleString() for c in columns} | {"h_n": "long"} | {f"h_{c}": "double" for c in (*quantiles, *(["mad"] if mad else []))}
    return sent.groupBy("_key", "_b", "_c").applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in fields.items()))
