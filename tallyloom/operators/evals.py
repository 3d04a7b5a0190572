"""Scoring of run trajectories, suites, gates, agreement and sampling.

The built-in scorers need counts over a run's ordered events and never the
list itself, so they are partial aggregates; a run of any length is fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import any_of, div, hash31
from tallyloom.operators.runs import ORDER, RUN
from tallyloom.schema import ended, is_event

# The built-in scorers and what each one scores.
SCORERS = {
    "task_completed": "1 when the run completed",
    "clean_trajectory": "1 when the run completed and no step failed",
    "low_retry_churn": "1 minus retried steps over steps, at least 0",
    "no_human_intervention": "0 when a human took over, edited or overrode",
}


def rubric_hash(text: str) -> str:
    return "rb_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def trajectory_facts(events: DataFrame) -> DataFrame:
    """Per run: completed (by its last end event), steps, failed steps, retried steps, human intervention."""
    step = is_event("step_executed")
    failed = step & (F.col("status") != "") & (F.col("status") != "ok")
    return events.groupBy(*RUN).agg(
        F.max(F.when(ended(), F.struct(*ORDER, "event"))).alias("_last"),
        F.count_if(step).alias("steps"), F.count_if(failed).alias("failed_steps"),
        F.count_if(step & (F.col("retry_of_step_id") != "")).alias("retries"),
        any_of(is_event("handoff_to_human", "human_edited", "human_overrode")).alias("intervened"),
    ).select(*RUN, F.coalesce(F.col("_last.event") == "task_completed", F.lit(False)).alias("completed"),
             "steps", "failed_steps", "retries", "intervened")


def _score(value: Column, label: Column | None = None) -> Column:
    return F.struct(value.cast("double").alias("value"), (label if label is not None else F.lit(None).cast("string")).alias("label"))


def score_task_completed() -> Column:
    return _score(F.when(F.col("completed"), 1.0).otherwise(0.0))


def score_clean_trajectory() -> Column:
    done, bad = F.col("completed"), F.col("failed_steps")
    return _score(F.when(done & (bad == 0), 1.0).otherwise(0.0),
                  F.when(~done, "not_completed").when(bad > 0, F.concat(F.lit("failed_steps:"), bad.cast("string"))))


def score_low_retry_churn() -> Column:
    n = F.col("steps")
    return _score(F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - div(F.col("retries"), n))), F.when(n == 0, "no_steps"))


def score_no_human_intervention() -> Column:
    return _score(F.when(F.col("intervened"), 0.0).otherwise(1.0))


_BUILD: dict[str, Callable[[], Column]] = {
    "task_completed": score_task_completed, "clean_trajectory": score_clean_trajectory,
    "low_retry_churn": score_low_retry_churn, "no_human_intervention": score_no_human_intervention,
}


def score_runs(facts: DataFrame, scorers: Sequence[str] = tuple(SCORERS), keep: Sequence[str] = ()) -> DataFrame:
    """One row per run and scorer: value in [0, 1], label, evaluator identity."""
    unknown = [s for s in scorers if s not in _BUILD]
    if unknown:
        raise ValueError(f"unknown scorers: {unknown}")
    rows = F.array(*[
        F.struct(F.lit(s).alias("scorer_id"), F.lit("code").alias("kind"), F.lit(rubric_hash(SCORERS[s])).alias("rubric_hash"), _BUILD[s]().alias("s"))
        for s in scorers])
    out = facts.select(*RUN, *keep, F.inline(rows))
    return out.select(*RUN, *keep, "scorer_id", "kind", "rubric_hash", "s.value", "s.label")


def custom_scores(events: DataFrame, scorers: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """User scorers: each builds one aggregate Column over the events of a run.

    Built-in aggregates stay partial; a grouped-aggregate ``pandas_udf`` works
    too where the scorer has to see its run as a pandas column.
    """
    wide = events.groupBy(*RUN).agg(*[build().cast("double").alias(name) for name, build in scorers.items()])
    return wide.unpivot(list(RUN), list(scorers), "scorer_id", "value").withColumn("kind", F.lit("code"))


def run_suite(dataset: DataFrame, events: DataFrame, versions: Mapping[str, str], scorers: Sequence[str] = tuple(SCORERS)) -> DataFrame:
    """Scores of every case of a dataset (dataset_id, dataset_version, case_id and the run keys) with the version tuple."""
    missing = [v for v in ("prompt_version", "model_version", "agent_version") if not versions.get(v)]
    if missing:
        raise ValueError(f"versions required: {missing}")
    cases = dataset.join(trajectory_facts(events), list(RUN))
    scored = score_runs(cases, scorers, ["dataset_id", "dataset_version", "case_id"])
    return scored.withColumns({k: F.lit(v) for k, v in versions.items()})


def suite_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("dataset_id", "scorer_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("cases"))


def evaluate_gate(scores: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Per dataset and scorer: mean, bound, pass; a dataset passes when each of its rows does."""
    bound = _bound(thresholds)
    return suite_means(scores).where(F.col("scorer_id").isin(list(thresholds))).withColumn("min_mean", bound).withColumn(
        "passed", F.col("mean") >= F.col("min_mean"))


def failing_cases(scores: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Cases below the bound of a scorer that failed its gate."""
    failed = evaluate_gate(scores, thresholds).where(~F.col("passed")).select("dataset_id", "scorer_id", "min_mean")
    return scores.join(failed, ["dataset_id", "scorer_id"]).where(F.col("value") < F.col("min_mean")).select(
        "dataset_id", "scorer_id", "case_id", "value", "min_mean")


def _bound(thresholds: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, low in thresholds.items():
        out = F.when(F.col("scorer_id") == name, float(low)).otherwise(out)
    return out


def judge_agreement(scores: DataFrame, trace: Sequence[str], seq: str, tolerance: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of judge and human scores per trace (the last of each kind) and the share within the tolerance."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col(seq)))
    per = scores.groupBy(*by, *trace).agg(last("judge").alias("j"), last("human").alias("h"))
    both = F.col("j").isNotNull() & F.col("h").isNotNull()
    close = both & (F.round(F.abs(F.col("j") - F.col("h")), 12) <= tolerance)
    return per.groupBy(*by).agg(F.count_if(both).alias("pairs"), div(F.count_if(close), F.count_if(both)).alias("agreement"))


def sample_traces(df: DataFrame, key: Column, rate: float) -> DataFrame:
    """Deterministic sampling by the 32-bit hash of the trace key."""
    if rate >= 1:
        return df
    if rate <= 0:
        return df.where(F.lit(False))
    return df.where(hash31(key) / F.lit(4294967295.0) < rate)
