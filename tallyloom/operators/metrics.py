"""The semantic layer: named metrics as Column builders over the event table.

Every metric returns one row per tenant (and segment, tool or week). A ratio
without a denominator is NULL and means "no data"; the metrics that guard with
1 give 0 instead. Both rules are kept per metric on purpose.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.quantiles import grouped_quantiles
from tallyloom.functions.scalars import any_of, count_if, div, guarded_div, sunday_week
from tallyloom.plans.session import written
from tallyloom.schema import IDENTITY, ended, human_touch, is_event
from tallyloom.sources.events import ALL_TENANTS, Scope, fold_copies, insert_order, scan_events

SEGMENTS = ("task_type", "agent_version", "agent_name")


@dataclass(frozen=True)
class MetricArgs:
    tenant: str
    start: str
    end: str
    segment_by: str | None = None
    pivot: str | None = None

    @property
    def scope(self) -> Scope:
        return Scope(self.tenant, self.start, self.end)

    def after_pivot(self) -> Column:
        return F.col("timestamp") >= F.lit(self.pivot).cast("timestamp_ntz")


Aggs = Callable[[MetricArgs], list[Column]]


@dataclass(frozen=True)
class Metric:
    layer: str
    aggs: Aggs
    reads: tuple[str, ...] = ()
    #: on columns of the dedup identity only, so that it may precede the folding of copies
    where: Callable[[], Column] | None = None
    #: on other columns: copies may differ in these, so it follows the folding
    late: Callable[[], Column] | None = None
    #: level-1 grouping below the tenant and its flags; aggs then read the flags
    per: tuple[str, ...] = ()
    flags: Callable[[], list[Column]] | None = None
    having: Callable[[], Column] | None = None
    #: extra output keys: name -> Column over the (level-1) rows
    keys: dict[str, Callable[[], Column]] = field(default_factory=dict)
    quantiles: tuple[str, dict[str, float]] | None = None
    needs_pivot: bool = False
    note: str = ""


def _steps() -> Column:
    return is_event("step_executed")


def _starts() -> Column:
    return is_event("task_started")


def _week() -> Column:
    return sunday_week(F.col("timestamp"))


def _distinct_tasks() -> Column:
    return F.countDistinct("task_id")


def _task_flags() -> list[Column]:
    return [
        any_of(is_event("task_completed") & (F.col("verification") == "self_reported")).alias("self_reported"),
        any_of(
            is_event("human_edited", "human_overrode")
            | (is_event("feedback_given") & (F.col("rating_value") == 0))
        ).alias("contested"),
        any_of(is_event("task_completed")).alias("completed"),
        any_of(human_touch()).alias("touched"),
        any_of(ended()).alias("has_end"),
    ]


def _pivot_success(a: MetricArgs) -> list[Column]:
    after = a.after_pivot()
    done = is_event("task_completed")
    return [
        (
            guarded_div(count_if(done & after), count_if(after))
            - guarded_div(count_if(done & ~after), count_if(~after))
        ).alias("value")
    ]


def _growth(a: MetricArgs) -> list[Column]:
    cur, prev = count_if(a.after_pivot()), count_if(~a.after_pivot())
    return [
        cur.alias("current"),
        prev.alias("previous"),
        guarded_div(cur - prev, prev).alias("value"),
    ]


def _value(col: Column) -> list[Column]:
    return [col.alias("value")]


METRICS: dict[str, Metric] = {
    # T: task success
    "task_success_rate": Metric(
        "T", lambda a: [div(count_if(is_event("task_completed")), F.count(F.lit(1))).alias("value"),
                        F.count(F.lit(1)).alias("ended_tasks")], where=ended),
    "overclaim_rate": Metric(
        "T", lambda a: [div(count_if(F.col("contested")), F.count(F.lit(1))).alias("value"),
                        F.count(F.lit(1)).alias("self_reported_tasks")],
        reads=("task_id", "verification", "rating_value"), per=("task_id",), flags=_task_flags,
        having=lambda: F.col("self_reported")),
    "first_run_resolution": Metric(
        "T", lambda a: _value(div(count_if((F.col("runs") == 1) & F.col("completed")), count_if(F.col("completed")))),
        reads=("task_id", "run_id"), per=("task_id",),
        flags=lambda: [F.countDistinct("run_id").alias("runs"), any_of(is_event("task_completed")).alias("completed")]),
    "abandonment_rate": Metric(
        "T", lambda a: _value(div(count_if(is_event("task_abandoned")), F.count(F.lit(1)))), where=ended),
    # O: operational efficiency
    "cost_per_completed_task": Metric(
        "O", lambda a: [div(F.sum("cost_usd"), count_if(is_event("task_completed"))).alias("value"),
                        F.sum("cost_usd").alias("total_cost_usd")], reads=("cost_usd",)),
    "tokens_per_task": Metric(
        "O", lambda a: _value(div(F.sum(F.col("tokens_in") + F.col("tokens_out")), _distinct_tasks())),
        reads=("task_id", "tokens_in", "tokens_out"), where=_steps),
    "steps_per_task": Metric(
        "O", lambda a: _value(div(F.count(F.lit(1)), _distinct_tasks())), reads=("task_id",), where=_steps),
    "latency_p95": Metric(
        "O", lambda a: [], reads=("latency_ms",), where=_steps,
        quantiles=("latency_ms", {"value": 0.95, "p50": 0.5})),
    "loop_retry_ratio": Metric(
        "O", lambda a: _value(div(count_if(F.col("retry_of_step_id") != ""), F.count(F.lit(1)))),
        reads=("retry_of_step_id",), where=_steps),
    "per_tool_failure_rate": Metric(
        "O", lambda a: _value(div(count_if(F.col("status") != "ok"), F.count(F.lit(1)))),
        reads=("tool_name", "status"), where=_steps, late=lambda: F.col("tool_name") != "",
        keys={"tool_name": lambda: F.col("tool_name")}),
    # Q: quality and drift
    "human_edit_distance": Metric(
        "Q", lambda a: [F.avg("edit_magnitude_value").alias("value"), F.count(F.lit(1)).alias("edits")],
        reads=("edit_magnitude_value",), where=lambda: is_event("human_edited")),
    "regression_delta": Metric("Q", _pivot_success, where=ended, needs_pivot=True,
                               note="success after the pivot minus success before it"),
    "complaint_rate": Metric(
        "Q", lambda a: _value(guarded_div(count_if(is_event("feedback_given") & (F.col("rating_value") == 0)),
                                          count_if(is_event("task_completed")))), reads=("rating_value",)),
    # A: autonomy and trust
    "autonomy_rate": Metric(
        "A", lambda a: _value(div(count_if(~F.col("touched")), F.count(F.lit(1)))),
        reads=("task_id", "verification", "rating_value"), per=("task_id",), flags=_task_flags,
        having=lambda: F.col("has_end")),
    "escalation_rate": Metric(
        "A", lambda a: _value(guarded_div(count_if(is_event("handoff_to_human")), _distinct_tasks())), reads=("task_id",)),
    "override_rate": Metric(
        "A", lambda a: _value(guarded_div(count_if(is_event("human_overrode")), _distinct_tasks())), reads=("task_id",)),
    "approval_friction": Metric(
        "A", lambda a: [], reads=("response_latency_ms",), where=lambda: is_event("human_approved"),
        quantiles=("response_latency_ms", {"value": 0.5, "p95": 0.95})),
    # R: retention and expansion
    "weekly_task_actors": Metric(
        "R", lambda a: _value(F.countDistinct("session_id")), reads=("session_id",),
        where=_starts, late=lambda: F.col("session_id") != "", keys={"week": _week},
        note="the session stands in for the account"),
    "task_depth_expansion": Metric(
        "R", lambda a: _value(F.countDistinct("task_type")), where=_starts, keys={"week": _week}),
    "delegation_share": Metric(
        "R", lambda a: _value(div(count_if(F.col("initiator").isin("agent", "schedule")), F.count(F.lit(1)))),
        reads=("initiator",), where=_starts),
    "quality_cohort_retention": Metric(
        "R", lambda a: _value(F.count(F.lit(1))), reads=("session_id",),
        late=lambda: F.col("session_id") != "", per=("session_id", "week"),
        flags=lambda: [any_of(is_event("human_overrode")).alias("overridden")],
        keys={"week": lambda: F.col("week"),
              "cohort": lambda: F.when(F.col("overridden"), "overridden").otherwise("clean")},
        note="the session stands in for the account"),
    "net_task_growth": Metric("R", _growth, where=lambda: is_event("task_completed"), needs_pivot=True,
                              note="the pivot splits the window in two periods"),
}


def list_metrics() -> list[dict[str, str]]:
    return [{"name": n, "layer": m.layer, "note": m.note} for n, m in METRICS.items()]


def check_args(name: str, args: MetricArgs) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    if args.segment_by is not None and args.segment_by not in SEGMENTS:
        raise ValueError(f"unknown segment dimension: {args.segment_by}")
    if METRICS[name].needs_pivot and not args.pivot:
        raise ValueError(f"metric {name} requires a pivot timestamp")
    args.scope  # a missing tenant raises here
    return METRICS[name]


def query_id(name: str, args: MetricArgs) -> str:
    """Stable citation id of a metric with its parameters."""
    check_args(name, args)
    params = {k: v for k, v in vars(args).items() if v is not None}
    if not METRICS[name].needs_pivot:
        params.pop("pivot", None)
    text = json.dumps({"metric": name, **params}, sort_keys=True)
    return "q_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def metric(name: str, events: DataFrame, args: MetricArgs, deduped: bool = False) -> DataFrame:
    """One metric for one tenant or, with ``ALL_TENANTS``, for all at once.

    Reads fold redelivered copies first. Pass ``deduped=True`` for a table that
    was compacted: the read then needs no shuffle on the event identity.
    """
    m = check_args(name, args)
    seg = [args.segment_by] if args.segment_by else []
    rows = scan_events(events, args.scope)
    if m.where is not None:
        rows = rows.where(m.where())
    rows = rows.select(*dict.fromkeys([*IDENTITY, *m.reads, *seg, *insert_order(events)]))
    if not deduped:
        rows = fold_copies(rows)
    return _measured(m, rows, args, seg)


def _measured(m: Metric, rows: DataFrame, args: MetricArgs, seg: list[str]) -> DataFrame:
    """A metric of rows that its first filter let through, by tenant and the columns ``seg``."""
    if m.late is not None:
        rows = rows.where(m.late())
    if m.per:
        if "week" in m.per:
            rows = rows.withColumn("week", _week())
        level1 = list(dict.fromkeys(["tenant_id", *seg, *m.per]))
        rows = rows.groupBy(*level1).agg(*m.flags())
        if m.having is not None:
            rows = rows.where(m.having())
    for key, build in m.keys.items():
        rows = rows.withColumn(key, build())
    by = ["tenant_id", *seg, *m.keys]
    if m.quantiles is not None:
        value, probs = m.quantiles
        return grouped_quantiles(rows, by, value, probs)
    return rows.groupBy(*by).agg(*m.aggs(args))


def segment_metrics(events: DataFrame, names: Sequence[str], args: MetricArgs, segments: Sequence[str] | None = None, deduped: bool = False) -> DataFrame:
    """Metrics of one value by many segment dimensions: metric, segment, tenant, segment value, value.

    The events are scanned and folded once. A row counts in each of its
    segments, so one grouping serves all dimensions of a metric.
    """
    segments = list(segments or SEGMENTS)
    for name in names:
        for s in segments:
            check_args(name, replace(args, segment_by=s))
    kinds = [METRICS[n] for n in names]
    rows = scan_events(events, args.scope).select(*dict.fromkeys([*IDENTITY, *(c for m in kinds for c in m.reads), *segments, *insert_order(events)]))
    rows = written(rows if deduped else fold_copies(rows), "segmented")
    dims = F.inline(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("segment_value")) for s in segments]))
    parts = []
    for name, m in zip(names, kinds):
        own = rows if m.where is None else rows.where(m.where())
        part = _measured(m, own.select(*rows.columns, dims), args, ["segment", "segment_value"])
        parts.append(part.select(F.lit(name).alias("metric"), "segment", "tenant_id", "segment_value", "value"))
    return reduce(DataFrame.unionByName, parts)


# Metrics of one value per tenant that the panel serves from one task rollup.
PANEL = (
    "task_success_rate", "abandonment_rate", "overclaim_rate", "first_run_resolution", "cost_per_completed_task",
    "tokens_per_task", "steps_per_task", "loop_retry_ratio", "human_edit_distance", "regression_delta",
    "complaint_rate", "autonomy_rate", "escalation_rate", "override_rate", "delegation_share", "net_task_growth",
)


def task_rollup(events: DataFrame, args: MetricArgs) -> DataFrame:
    """Per task: every count, sum and flag the panel needs (one shuffle on tenant and task)."""
    after = args.after_pivot() if args.pivot else F.lit(None).cast("boolean")
    done, step = is_event("task_completed"), _steps()
    seg = [args.segment_by] if args.segment_by else []
    return events.groupBy("tenant_id", *seg, "task_id").agg(
        count_if(done).alias("completed_n"),
        count_if(ended()).alias("ended_n"),
        count_if(is_event("task_abandoned")).alias("abandoned_n"),
        count_if(done & after).alias("done_after"),
        count_if(done & ~after).alias("done_before"),
        count_if(ended() & after).alias("ended_after"),
        count_if(ended() & ~after).alias("ended_before"),
        F.sum("cost_usd").alias("cost"),
        F.sum(F.when(step, F.col("tokens_in") + F.col("tokens_out"))).alias("tokens"),
        count_if(step).alias("steps"),
        count_if(step & (F.col("retry_of_step_id") != "")).alias("retries"),
        count_if(is_event("human_edited")).alias("edits"),
        F.sum(F.when(is_event("human_edited"), F.col("edit_magnitude_value"))).alias("edit_sum"),
        count_if(is_event("feedback_given") & (F.col("rating_value") == 0)).alias("complaints"),
        count_if(is_event("handoff_to_human")).alias("handoffs"),
        count_if(is_event("human_overrode")).alias("overrides"),
        count_if(_starts()).alias("starts"),
        count_if(_starts() & F.col("initiator").isin("agent", "schedule")).alias("delegated"),
        # "exactly one run" needs no distinct count: the smallest and largest run id agree
        (F.min("run_id") == F.max("run_id")).alias("one_run"),
        *_task_flags(),
    )


def metric_panel(events: DataFrame, args: MetricArgs, names=PANEL, deduped: bool = False) -> DataFrame:
    """Many metrics for many tenants from one scan: (tenant, [segment], metric, value).

    Everything, the distinct task counts too, is an ordinary sum over the task
    rollup, so there is no Expand for several distinct counts.
    """
    unknown = [n for n in names if n not in PANEL]
    if unknown:
        raise ValueError(f"not served by the panel: {unknown}")
    seg = [args.segment_by] if args.segment_by else []
    rows = scan_events(events, args.scope)
    if not deduped:
        rows = fold_copies(rows)
    t = task_rollup(rows, args)
    s = lambda c: F.sum(c)
    tasks = F.count(F.lit(1))
    completed = count_if(F.col("completed"))
    build = {
        "task_success_rate": div(s("completed_n"), s("ended_n")),
        "abandonment_rate": div(s("abandoned_n"), s("ended_n")),
        "overclaim_rate": div(count_if(F.col("self_reported") & F.col("contested")), count_if(F.col("self_reported"))),
        "first_run_resolution": div(count_if(F.col("one_run") & F.col("completed")), completed),
        "cost_per_completed_task": div(s("cost"), s("completed_n")),
        "tokens_per_task": div(s("tokens"), count_if(F.col("steps") > 0)),
        "steps_per_task": div(s("steps"), count_if(F.col("steps") > 0)),
        "loop_retry_ratio": div(s("retries"), s("steps")),
        "human_edit_distance": div(s("edit_sum"), s("edits")),
        "regression_delta": guarded_div(s("done_after"), s("ended_after")) - guarded_div(s("done_before"), s("ended_before")),
        "complaint_rate": guarded_div(s("complaints"), s("completed_n")),
        "autonomy_rate": div(count_if(F.col("has_end") & ~F.col("touched")), count_if(F.col("has_end"))),
        "escalation_rate": guarded_div(s("handoffs"), tasks),
        "override_rate": guarded_div(s("overrides"), tasks),
        "delegation_share": div(s("delegated"), s("starts")),
        "net_task_growth": guarded_div(s("done_after") - s("done_before"), s("done_before")),
    }
    if not args.pivot:
        names = [n for n in names if not METRICS[n].needs_pivot]
    wide = t.groupBy("tenant_id", *seg).agg(*[build[n].alias(n) for n in names])
    return wide.unpivot(["tenant_id", *seg], list(names), "metric", "value")


def exact_sum(col: str) -> Column:
    """Sum of amounts as decimals, so that it doesn't depend on the order of the rows."""
    return F.sum(F.col(col).cast("decimal(28,12)")).cast("double")


def daily_rollup_build(events: DataFrame) -> DataFrame:
    """Per tenant, task type and day. Takes de-duplicated events, so replays never count twice."""
    return events.groupBy("tenant_id", "task_type", F.to_date("timestamp").alias("day")).agg(
        count_if(is_event("task_completed")).alias("completed"),
        count_if(ended()).alias("ended"),
        count_if(is_event("task_abandoned")).alias("abandoned"),
        exact_sum("cost_usd").alias("cost_usd"),
        F.count(F.lit(1)).alias("events"),
    )


def daily_rollup_read(rollup: DataFrame, args: MetricArgs) -> DataFrame:
    """Daily series; unlike the metrics, the day of ``end`` is included."""
    args.scope
    day = F.col("day")
    cond = (day >= F.to_date(F.lit(args.start))) & (day <= F.to_date(F.lit(args.end)))
    if args.tenant != ALL_TENANTS:
        cond = cond & (F.col("tenant_id") == args.tenant)
    done, end, cost = F.sum("completed"), F.sum("ended"), exact_sum("cost_usd")
    return rollup.where(cond).groupBy("tenant_id", "day").agg(
        done.alias("completed_tasks"),
        end.alias("ended_tasks"),
        F.sum("abandoned").alias("abandoned_tasks"),
        cost.alias("total_cost_usd"),
        guarded_div(done, end).alias("task_success_rate"),
        guarded_div(cost, done).alias("cost_per_completed_task"),
    )


ARM_METRICS = ("task_success_rate", "cost_per_completed_task", "override_rate")


def per_arm_metrics(events: DataFrame, exposures: DataFrame, names: Sequence[str], args: MetricArgs, deduped: bool = False) -> DataFrame:
    """Guardrail metrics per exposure arm: tenant, arm, value, metric; ``exposures`` holds (subject, arm), subject = task id.

    Events and exposures are joined once for all metrics. No broadcast hint:
    Spark broadcasts the exposures only when their size is known to be small,
    else it joins by shuffle and splits skewed tasks.
    """
    unknown = [n for n in names if n not in ARM_METRICS]
    if unknown:
        raise ValueError(f"no experiment guardrails: {unknown}")
    kinds = {n: check_args(n, args) for n in names}
    rows = scan_events(events, args.scope).select(*dict.fromkeys([*IDENTITY, "task_id", *(c for m in kinds.values() for c in m.reads), *insert_order(events)]))
    if not deduped:
        rows = fold_copies(rows)
    joined = written(rows.join(exposures, rows["task_id"] == exposures["subject"]), "exposed")
    parts = []
    for name, m in kinds.items():
        own = joined
        for keep in (m.where, m.late):
            own = own if keep is None else own.where(keep())
        parts.append(own.groupBy("tenant_id", "arm").agg(*m.aggs(args)).select("tenant_id", "arm", "value", F.lit(name).alias("metric")))
    return reduce(DataFrame.unionByName, parts)


def per_arm_metric(events: DataFrame, exposures: DataFrame, name: str, args: MetricArgs, deduped: bool = False) -> DataFrame:
    """One guardrail metric per exposure arm."""
    return per_arm_metrics(events, exposures, [name], args, deduped).drop("metric")
