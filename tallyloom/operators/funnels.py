"""Funnels over product events: journeys, step rates, paths, comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.blocks import ROWS_PER_BLOCK, cut
from tallyloom.functions.scalars import div

FOLDED = 1024  # block summaries folded at a time
OPERATORS = ("equals", "not_equals", "contains", "not_contains", "greater_than", "less_than")


@dataclass(frozen=True)
class Condition:
    property: str
    operator: str
    value: object


@dataclass(frozen=True)
class Step:
    id: str
    event_type: str
    conditions: tuple[Condition, ...] = ()


def check_funnel(steps: Sequence[Step]) -> None:
    if not 2 <= len(steps) <= 20:
        raise ValueError("a funnel has 2 to 20 steps")
    if len({s.id for s in steps}) != len(steps):
        raise ValueError("step ids must be unique")
    for s in steps:
        for c in s.conditions:
            if not c.property or c.value is None:
                raise ValueError(f"invalid condition in step {s.id}")
            if c.operator not in OPERATORS:
                raise ValueError(f"unknown operator {c.operator} in step {s.id}")


def step_condition(cond: Condition, properties: str = "props") -> Column:
    """Predicate of one condition; ``properties.x`` looks into the JSON column.

    A missing property differs from every value and contains nothing.
    """
    if cond.property.startswith("properties."):
        value = F.get_json_object(properties, "$." + cond.property[len("properties."):])
    else:
        value = F.col(cond.property)
    want = cond.value
    number = isinstance(want, (int, float)) and not isinstance(want, bool)
    same = (value.try_cast("double") == F.lit(float(want))) if number else (value.cast("string") == F.lit(str(want)))
    holds = F.contains(value.cast("string"), F.lit(str(want)))
    test = {
        "equals": lambda: F.coalesce(same, F.lit(False)),
        "not_equals": lambda: F.coalesce(~same, F.lit(True)),
        "contains": lambda: F.coalesce(holds, F.lit(False)),
        "not_contains": lambda: F.coalesce(~holds, F.lit(True)),
        "greater_than": lambda: F.coalesce(value.try_cast("double") > F.lit(float(want)), F.lit(False)),
        "less_than": lambda: F.coalesce(value.try_cast("double") < F.lit(float(want)), F.lit(False)),
    }
    return test[cond.operator]()


def step_match(step: Step, type_col: str = "event_type", properties: str = "props") -> Column:
    cond = F.col(type_col) == step.event_type
    for c in step.conditions:
        cond = cond & step_condition(c, properties)
    return cond


def funnel_events(events: DataFrame, steps: Sequence[Step], start: str, end: str, filters: Sequence[Condition] = (),
                  ts: str = "ts", type_col: str = "event_type", properties: str = "props") -> DataFrame:
    """Events of the funnel's types in the closed time range, after the extra filters."""
    types = sorted({s.event_type for s in steps})
    out = events.where(F.col(type_col).isin(types) & (F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
                       & (F.col(ts) <= F.lit(end).cast("timestamp_ntz")))
    for c in filters:
        out = out.where(step_condition(c, properties))
    return out


def funnel_journeys(events: DataFrame, steps: Sequence[Step], user: str = "user_id", ts: str = "ts",
                    type_col: str = "event_type", properties: str = "props", keep: Sequence[str] = (),
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row per user: when each step was reached, in order and strictly one after the other.

    Events of the same user and moment are one row first, so that a moment lies
    in one block. The moments are cut in blocks by counts; a block says, for
    every step a user could be at when it begins, when it completes which
    steps. Such summaries compose, so they are folded by groups of blocks
    before they meet per user: no array grows with a user's history but the
    last, by one entry for FOLDED full blocks. ``keep`` carries properties of
    the user's first event.
    """
    check_funnel(steps)
    k = len(steps)
    marks = [f"_m{i}" for i in range(k)]
    marked = events.select(
        F.col(user), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"),
        *[F.coalesce(step_match(s, type_col, properties) & F.col(ts).isNotNull(), F.lit(False)).alias(m) for s, m in zip(steps, marks, strict=True)], *keep)
    moments = marked.groupBy(user, "_t").agg(F.array(*[F.max(m) for m in marks]).alias("_m"), *[F.first(c).alias(c) for c in keep])
    rows = cut(moments, [user], ["_t"], rows_per_block)
    none = F.array().cast("array<bigint>")

    def walk(seen: Column, j: int) -> Column:
        """Times of the steps from ``j`` on, one moment after the other; a moment completes one step."""
        return F.aggregate(seen, none, lambda done, x: F.when(
            F.try_element_at(x["_m"], F.size(done) + j + 1), F.concat(done, F.array(x["_t"]))).otherwise(done))

    def advance(done: Column, paths: Column) -> Column:
        return F.concat(done, F.coalesce(F.try_element_at(paths, F.size(done) + 1), none))

    def composed(blocks: Column) -> Column:
        """The summary of consecutive blocks: for each step at entry, the steps completed from it on."""
        return F.array(*[
            F.slice(F.aggregate(blocks, F.array_repeat(F.lit(0), j).cast("array<bigint>"), lambda done, blk: advance(done, blk["_paths"])), j + 1, k)
            for j in range(k)])

    opening = [F.min_by(c, "_t").alias(c) for c in keep]
    matching = F.array_sort(F.collect_list(F.when(F.exists("_m", lambda m: m), F.struct("_t", "_m"))))
    per_block = rows.groupBy("_key", "_block").agg(F.min("_t").alias("_t"), matching.alias("_seen"), *opening)
    per_block = per_block.withColumn("_paths", F.array(*[walk(F.col("_seen"), j) for j in range(k)])).drop("_seen")
    listed = F.array_sort(F.collect_list(F.struct("_block", "_paths"))).alias("_blocks")
    groups = per_block.groupBy("_key", F.floor(F.col("_block") / FOLDED).alias("_group")).agg(F.min("_t").alias("_t"), listed, *opening)
    groups = groups.select("_key", F.col("_group").alias("_block"), "_t", composed(F.col("_blocks")).alias("_paths"), *keep)
    users = groups.groupBy("_key").agg(F.min("_t").alias("start_us"), listed, *opening)
    users = users.withColumn(user, F.col("_key")[user]).drop("_key")
    times = F.aggregate("_blocks", none, lambda done, blk: advance(done, blk["_paths"]))
    out = users.withColumn("step_us", times).drop("_blocks")
    n = F.size("step_us")
    return out.select(
        user, *keep, "start_us", "step_us", n.alias("completed_steps"),
        F.when(n < k, n + 1).alias("dropoff_step"),
        F.when(n == k, (F.element_at("step_us", k) - F.col("start_us")) / 1000.0).alias("conversion_ms"),
    )


def funnel_steps(journeys: DataFrame, steps: Sequence[Step], by: Sequence[str] = ()) -> DataFrame:
    """Users reaching each step, rate against the previous one, and mean time since it."""
    aggs = [F.count(F.lit(1)).alias("_all")]
    for i in range(1, len(steps) + 1):
        aggs.append(F.count_if(F.col("completed_steps") >= i).alias(f"_n{i}"))
        if i > 1:
            gap = (F.try_element_at("step_us", F.lit(i)) - F.try_element_at("step_us", F.lit(i - 1))) / 1000.0
            aggs.append(F.avg(F.when(F.col("completed_steps") >= i, gap)).alias(f"_g{i}"))
    wide = journeys.groupBy(*by).agg(*aggs)
    rows = []
    for i, s in enumerate(steps, start=1):
        base = F.col("_all") if i == 1 else F.col(f"_n{i - 1}")
        rate = F.coalesce(div(F.col(f"_n{i}"), base), F.lit(0.0))
        mean_gap = F.lit(0.0) if i == 1 else F.coalesce(F.col(f"_g{i}"), F.lit(0.0))
        rows.append(F.struct(
            F.lit(i).alias("step"), F.lit(s.id).alias("step_id"), F.col(f"_n{i}").alias("users"),
            rate.alias("conversion_rate"), (F.lit(1.0) - rate).alias("dropoff_rate"), mean_gap.alias("mean_ms_from_previous")))
    return wide.select(*by, F.inline(F.array(*rows)))


def funnel_summary(journeys: DataFrame, steps: Sequence[Step], by: Sequence[str] = ()) -> DataFrame:
    done = F.col("completed_steps") == len(steps)
    rate = F.coalesce(div(F.count_if(done), F.count(F.lit(1))), F.lit(0.0))
    return journeys.groupBy(*by).agg(
        F.count(F.lit(1)).alias("users"), rate.alias("completion_rate"), (F.lit(1.0) - rate).alias("dropoff_rate"),
        F.coalesce(F.avg("conversion_ms"), F.lit(0.0)).alias("mean_conversion_ms"))


def funnel_breakdown(journeys: DataFrame, steps: Sequence[Step], prop: str) -> DataFrame:
    """Users and completion rate per property value, best first (``rank``); no value is 'unknown'."""
    value = F.coalesce(F.when(F.col(prop).cast("string") != "", F.col(prop).cast("string")), F.lit("unknown"))
    out = journeys.groupBy(value.alias("value")).agg(
        F.count(F.lit(1)).alias("users"),
        div(F.count_if(F.col("completed_steps") == len(steps)), F.count(F.lit(1))).alias("conversion_rate"))
    out = out.withColumn("property", F.lit(prop))
    return out.withColumn("rank", F.row_number().over(
        Window.partitionBy("property").orderBy(F.desc("conversion_rate"), F.desc("users"), "value")))


def funnel_by_segment(journeys: DataFrame, steps: Sequence[Step], segment: str) -> DataFrame:
    """Step results and summary per segment value."""
    seg = F.coalesce(F.when(F.col(segment).cast("string") != "", F.col(segment).cast("string")), F.lit("unknown"))
    named = journeys.withColumn("segment", seg)
    summary = funnel_summary(named, steps, ["segment"]).select(
        "segment", F.col("users").alias("segment_users"), "completion_rate", "mean_conversion_ms")
    return funnel_steps(named, steps, ["segment"]).join(summary, "segment")


def conversion_paths(journeys: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Completed steps as a path: users, completion, mean time, and who of those at its last step stops there."""
    ids = F.array(*[F.lit(s.id) for s in steps])
    full = F.col("completed_steps") == len(steps)
    per = journeys.groupBy("completed_steps").agg(
        F.count(F.lit(1)).alias("users"), F.coalesce(F.avg("conversion_ms"), F.lit(0.0)).alias("mean_ms"))
    at_least = F.sum("users").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("completed_steps")))
    path = F.when(F.col("completed_steps") == 0, "").otherwise(F.array_join(F.slice(ids, 1, F.greatest(F.col("completed_steps"), F.lit(1))), "->"))
    return per.select(
        path.alias("path"), "users", F.when(full, 1.0).otherwise(0.0).alias("conversion_rate"), "mean_ms",
        F.when(full, 0.0).otherwise(div(F.col("users"), at_least)).alias("dropoff_rate"))


def compare_funnels(current: DataFrame, previous: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Change of completion rate and users between the journeys of two periods."""
    cur, prev = (funnel_summary(j, steps).select("users", "completion_rate") for j in (current, previous))
    both = cur.select(F.struct("*").alias("c"), F.lit(1).alias("one")).join(
        prev.select(F.struct("*").alias("p"), F.lit(1).alias("one")), "one")

    def row(label: str, name: str) -> Column:
        c, p = F.col(f"c.{name}").cast("double"), F.col(f"p.{name}").cast("double")
        pct = F.when(p > 0, (c - p) / p * 100).otherwise(0.0)
        return F.struct(F.lit(label).alias("metric"), c.alias("current_value"), p.alias("comparison_value"),
                        (c - p).alias("change"), pct.alias("change_percent"))

    return both.select(F.inline(F.array(row("Completion Rate", "completion_rate"), row("Total Users", "users"))))


def grade(rate: Column) -> Column:
    return F.when(rate >= 0.8, "excellent").when(rate >= 0.6, "good").when(rate >= 0.3, "needs_improvement").otherwise("poor")


def funnel_insights(step_results: DataFrame) -> DataFrame:
    """Grade, issue flag and target rate per step."""
    rate = F.col("conversion_rate")
    return step_results.select(
        "step", "step_id", "conversion_rate", "dropoff_rate", grade(rate).alias("performance"),
        (F.col("dropoff_rate") > 0.5).alias("high_dropoff"),
        F.least(F.lit(0.95), rate * 1.2).alias("target_rate"))
