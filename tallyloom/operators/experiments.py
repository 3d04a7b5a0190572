"""Experiments: sequential tests, monitoring, assignment, variant results and decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.blocks import numbered, positions, running_sums
from tallyloom.functions.scalars import div, hash31_abs, probit

INF = float("inf")

# Defaults of the decision rules.
MIN_SAMPLE = 1000
MAX_DAYS = 30
ALPHA = 0.05
MIN_EFFECT = 0.05
POWER = 0.8

# The direction in which each guardrail does harm.
HARM = {"override_rate": "increase", "cost_per_completed_task": "increase", "task_success_rate": "decrease"}


# ---- sequential test -----------------------------------------------------

def _radius(n: Column, alpha: float, rho: float) -> Column:
    """Normal-mixture confidence-sequence radius of a [0, 1]-bounded mean (variance at most 1/4)."""
    n = n.cast("double")
    spread = F.lit(0.25) * (n * rho + 1) / (n * n * rho)
    return F.sqrt(spread * F.greatest(F.log((n * rho + 1) / F.lit(alpha * alpha)), F.lit(0.0)))


def _evaluated(nc: Column, sc: Column, nv: Column, sv: Column, alpha: float, rho: float) -> dict[str, Column]:
    """Effect, always-valid interval and decision from the two arms' counts and sums."""
    both = (nc > 0) & (nv > 0)
    effect = F.when(both, div(sv, nv) - div(sc, nc)).otherwise(0.0)
    one = lambda n: _radius(F.when(n > 0, n), alpha / 2, rho)
    r = one(nc) + one(nv)
    lower = F.when(both, effect - r).otherwise(F.lit(-INF))
    upper = F.when(both, effect + r).otherwise(F.lit(INF))
    decision = F.when(lower > 0, "ship").when(upper < 0, "revert").otherwise("inconclusive")
    return {"effect": effect, "lower": lower, "upper": upper, "decision": decision}


def _by_arm(obs: DataFrame, keys: Sequence[str], arm: str, value: str) -> DataFrame:
    c, v = F.col(arm) == "control", F.col(arm) == "variant"
    return obs.groupBy(*keys).agg(
        F.count_if(c).alias("n_control"), F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0.0)).alias("_sc"),
        F.count_if(v).alias("n_variant"), F.coalesce(F.sum(F.when(v, F.col(value))), F.lit(0.0)).alias("_sv"))


def sequential_evaluate(obs: DataFrame, keys: Sequence[str], arm: str = "arm", value: str = "value",
                        alpha: float = 0.05, rho: float = 1.0) -> DataFrame:
    """Decision per experiment, valid under any number of looks. Arms are 'control' and 'variant'."""
    agg = _by_arm(obs, keys, arm, value)
    e = _evaluated(F.col("n_control"), F.col("_sc"), F.col("n_variant"), F.col("_sv"), alpha, rho)
    return agg.select(*keys, *[c.alias(n) for n, c in e.items()], "n_control", "n_variant")


def sequential_path(obs: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None, arm: str = "arm",
                    value: str = "value", alpha: float = 0.05, rho: float = 1.0) -> DataFrame:
    """The same after every paired observation: the i-th of each arm, in order.

    Positions and running sums are taken in blocks, so one huge experiment does
    not sit in one task; both arms' sums come from one pass. Blocks are cut by
    counts, or by ``block``, a monotone function of the order.
    """
    keys = list(keys)
    rows = obs.where(F.col(arm).isin("control", "variant")).select(*keys, arm, *order, F.col(value).cast("double").alias("_v"))
    pos = numbered(rows, [*keys, arm], order, "i") if block is None else positions(rows, [*keys, arm], order, block, "i")
    pairs = pos.groupBy(*keys, "i").agg(
        F.max(F.when(F.col(arm) == "control", F.col("_v"))).alias("_c"), F.max(F.when(F.col(arm) == "variant", F.col("_v"))).alias("_t"))
    pairs = pairs.where(F.col("_c").isNotNull() & F.col("_t").isNotNull())
    run = running_sums(pairs, keys, "i", ["_c", "_t"])
    e = _evaluated(F.col("i"), F.col("sum__c"), F.col("i"), F.col("sum__t"), alpha, rho)
    return run.select(*keys, "i", *[c.alias(n) for n, c in e.items()])


def first_stop(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First index at which a watcher would have stopped, and the decision there."""
    stop = F.when(F.col("decision") != "inconclusive", F.struct("i", "decision"))
    return path.groupBy(*keys).agg(F.min(stop).alias("_s"), F.max("i").alias("pairs")).select(
        *keys, "pairs", F.col("_s.i").alias("stopped_at"), F.coalesce("_s.decision", F.lit("inconclusive")).alias("decision"))


def sample_size(df: DataFrame, baseline: str, mde: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Fixed-horizon two-proportion size per arm for each row's baseline and absolute effect."""
    p1, d = F.col(baseline), F.col(mde)
    p2 = p1 + d
    z = probit(F.lit(1 - alpha / 2)) + probit(F.lit(power))
    var = p1 * (1 - p1) + p2 * (1 - p2)
    return df.withColumn("per_arm", F.ceil(F.try_divide(z * z * var, d * d)))


def monitor_experiments(obs: DataFrame, experiments: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Guardrails first: a harmful one stops the experiment; else the target decides by its intended direction.

    ``obs``: experiment_id, metric, arm, value. ``experiments``: experiment_id,
    target_metric, direction. All observations count; the test takes each arm's size.
    """
    keys = ["experiment_id", "metric"]
    ev = sequential_evaluate(obs.where(F.col("arm").isin("control", "variant")).select(*keys, "arm", "value"), keys, alpha=alpha)
    j = ev.join(experiments, "experiment_id")
    harm = F.lit("increase")
    for name, direction in HARM.items():
        harm = F.when(F.col("metric") == name, direction).otherwise(harm)
    is_target = F.col("metric") == F.col("target_metric")
    breach = ~is_target & F.when(harm == "increase", F.col("lower") > 0).otherwise(F.col("upper") < 0)
    t = lambda name: F.max(F.when(is_target, F.col(name))).alias(name)
    out = j.groupBy("experiment_id", "direction").agg(
        F.array_sort(F.collect_set(F.when(breach, F.col("metric")))).alias("breached"),
        t("effect"), t("lower"), t("upper"), t("n_control"), t("n_variant"))
    up, down = F.col("lower") > 0, F.col("upper") < 0
    by_target = (F.when(F.col("direction") == "increase", F.when(up, "ship").when(down, "revert"))
                 .otherwise(F.when(down, "ship").when(up, "revert")))
    stopped = F.size("breached") > 0
    decision = F.when(stopped, "revert").otherwise(by_target)
    status = F.when(stopped, "stopped").when(decision.isNull(), "inconclusive").otherwise("concluded")
    return out.select("experiment_id", status.alias("status"), decision.alias("decision"), "breached", "effect", "lower", "upper", "n_control", "n_variant")


# ---- assignment ----------------------------------------------------------

@dataclass(frozen=True)
class Variant:
    id: str
    allocation: float
    is_control: bool = False


def assign_variant(users: DataFrame, experiment_id: str, variants: Sequence[Variant], user: str = "user_id", out: str = "variant") -> DataFrame:
    """Deterministic assignment by hash of ``<user>_<experiment>`` against the cumulative allocation."""
    share = hash31_abs(F.concat(F.col(user).cast("string"), F.lit(f"_{experiment_id}"))) / F.lit(2147483647.0)
    fallback = next((v.id for v in variants if v.is_control), variants[0].id)
    pick, total, tests = F.lit(fallback), 0.0, []
    for v in variants:
        total += v.allocation
        tests.append((total, v.id))
    for bound, name in reversed(tests):
        pick = F.when(F.col("_share") <= bound, name).otherwise(pick)
    return users.withColumn("_share", share).withColumn(out, pick).drop("_share")


@dataclass(frozen=True)
class ExclusionRule:
    condition: str
    enabled: bool = True


def apply_exclusions(users: DataFrame, rules: Sequence[ExclusionRule], user: str = "user_id", properties: str | None = None) -> DataFrame:
    """Drop users a rule names: by id (with the word userId), or by a property key together with its value.

    Rules are definitions, so each becomes a predicate and there is no join.
    """
    hit = F.lit(False)
    uid = F.col(user).cast("string")
    for rule in rules:
        if not rule.enabled:
            continue
        text = F.lit(rule.condition)
        if "userId" in rule.condition:
            hit = hit | F.contains(text, uid)
        if properties is not None:
            hit = hit | F.exists(F.map_entries(properties), lambda e: F.contains(text, e["key"]) & F.contains(text, e["value"]))
    return users.where(~F.coalesce(hit, F.lit(False)))


def eligible_segments(users: DataFrame, segments: Sequence[Mapping[str, str]], properties: str) -> DataFrame:
    """Users that match every property of at least one segment; without segments, all of them."""
    if not segments:
        return users
    match = F.lit(False)
    for criteria in segments:
        fits = F.lit(True)
        for key, value in criteria.items():
            fits = fits & F.coalesce(F.try_element_at(properties, F.lit(key)) == value, F.lit(False))
        match = match | (fits | F.col(properties).isNull())
    return users.where(match)


# ---- results -------------------------------------------------------------

KEY = ("experiment_id", "variant_id")


def variant_results(exposures: DataFrame, conversions: DataFrame, variants: DataFrame) -> DataFrame:
    """Exposures, conversions, rate, revenue, deviation, 95% interval and traffic share per variant.

    ``exposures``: one row per (experiment_id, user_id) with its variant_id;
    ``conversions``: (experiment_id, user_id, value); ``variants``: the defined
    (experiment_id, variant_id, is_control). Conversions are summed per user
    before the join, so a user with many of them is one row.
    """
    per_user = conversions.groupBy("experiment_id", "user_id").agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("r"))
    agg = exposures.join(per_user, ["experiment_id", "user_id"], "left").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("exposed"), F.coalesce(F.sum("c"), F.lit(0)).alias("conversions"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("revenue"))
    rows = variants.join(agg, list(KEY), "left")
    exposed = F.coalesce("exposed", F.lit(0).cast("long"))
    n = F.greatest(exposed, F.lit(1).cast("long"))
    conv = F.coalesce("conversions", F.lit(0).cast("long"))
    rate = conv / n
    spread = F.greatest(rate * (1 - rate), F.lit(0.0))
    se = F.sqrt(spread / n)
    total = F.greatest(F.sum(exposed).over(Window.partitionBy("experiment_id")), F.lit(1).cast("long"))
    return rows.select(
        *KEY, "is_control", n.alias("sample_size"), conv.alias("conversions"), rate.alias("rate"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.sqrt(spread).alias("std_dev"), se.alias("std_error"),
        F.greatest(F.lit(0.0), rate - 1.96 * se).alias("ci_lower"), F.least(F.lit(1.0), rate + 1.96 * se).alias("ci_upper"),
        (n / total).alias("sample_ratio"))


def p_bucket(z: Column) -> Column:
    """Step function of |z| (fixed values); note that it gives 0.05, not less, up to 2.58."""
    a = F.abs(z)
    return F.when(a > 2.58, 0.01).when(a > 1.96, 0.05).when(a > 1.645, 0.1).when(a > 1.28, 0.2).otherwise(0.5)


def compare_to_control(results: DataFrame) -> DataFrame:
    """Lift, z, p bucket and t-test row of every treatment against its experiment's control."""
    control = results.where("is_control").select(
        "experiment_id", F.col("rate").alias("_cr"), F.col("std_error").alias("_cse"), F.col("sample_size").alias("_cn"))
    t = results.where(~F.col("is_control")).join(control, "experiment_id")
    pooled = F.sqrt(F.col("std_error") * F.col("std_error") + F.col("_cse") * F.col("_cse"))
    diff = F.col("rate") - F.col("_cr")
    z = F.when(pooled > 0, F.try_divide(diff, pooled)).otherwise(0.0)
    t = t.withColumn("z", z)
    p = p_bucket(F.col("z"))
    return t.select(
        *KEY, diff.alias("absolute_lift"), F.when(F.col("_cr") > 0, F.try_divide(diff, F.col("_cr"))).otherwise(0.0).alias("relative_lift"),
        "z", p.alias("p_bucket"), (F.col("sample_size") + F.col("_cn") - 2).alias("degrees_of_freedom"), (p < 0.05).alias("reject_null"))


def experiment_facts(results: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per experiment: what the power, risk, impact and decision rules read."""
    lifts = results.join(comparisons.select(*KEY, "relative_lift", "p_bucket", "reject_null"), list(KEY), "left")
    treated = ~F.col("is_control")
    # best treatment by rate; ties go to the smaller id
    best = F.min(F.when(treated, F.struct((-F.col("rate")).alias("r"), "variant_id", "relative_lift", "p_bucket")))
    ready = treated & (F.col("p_bucket") < ALPHA) & (F.abs(F.col("relative_lift")) >= MIN_EFFECT)
    sized = lifts.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("experiment_id")))
    out = sized.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("sample_size").alias("samples"),
        F.max(F.abs(F.col("sample_ratio") - 1.0 / F.col("_k"))).alias("imbalance"),
        F.count_if(F.coalesce("reject_null", F.lit(False))).alias("significant"),
        F.count_if(F.abs(F.coalesce("relative_lift", F.lit(0.0))) >= MIN_EFFECT).alias("practical"),
        F.max(F.when(F.col("is_control"), F.col("rate"))).alias("control_rate"),
        best.alias("_best"), F.min(F.when(ready, F.col("variant_id"))).alias("ready_variant"))
    return out.select("experiment_id", "variants", "samples", "imbalance", "significant", "practical", "control_rate",
                      F.col("_best.variant_id").alias("best_variant"), F.col("_best.relative_lift").alias("best_lift"),
                      F.col("_best.p_bucket").alias("best_p"), "ready_variant")


def experiment_power(facts: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    return facts.withColumn("power", F.least(F.col("samples") / (F.lit(float(min_sample)) * F.col("variants")), F.lit(1.0)))


def pooled_sample_size(df: DataFrame, baseline: str, variants: str, effect: float = MIN_EFFECT, alpha: float = ALPHA,
                       power: float = POWER, daily_traffic: int = 1000) -> DataFrame:
    """Size per variant for a relative effect, total and days at the given traffic; z values are the real ones."""
    p1 = F.coalesce(F.col(baseline), F.lit(0.05))
    p2 = p1 * (1 + effect)
    pooled = (p1 + p2) / 2
    z = probit(F.lit(1 - alpha / 2)) + probit(F.lit(power))
    per = F.ceil(F.try_divide(z * z * 2 * pooled * (1 - pooled), (p2 - p1) * (p2 - p1)))
    return df.withColumn("per_variant", per).withColumn("total_required", F.col("per_variant") * F.col(variants)).withColumn(
        "days", F.ceil(F.col("total_required") / F.lit(daily_traffic)))


def risk_assessment(facts: DataFrame, running_days: str, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Four risk factors, the overall risk and the confidence that goes with it."""
    need = F.lit(min_sample) * F.col("variants")
    days = F.coalesce(F.col(running_days), F.lit(0.0))
    out = facts.withColumns({
        "sample_risk": F.when(F.col("samples") < need * 0.5, "high").when(F.col("samples") < need, "medium").otherwise("low"),
        "bias_risk": F.when(F.col("imbalance") > 0.1, "medium").otherwise("low"),
        "validity_risk": F.when(days < 7, "high").when(days < 14, "medium").otherwise("low"),
        "implementation_risk": F.when(F.col("variants") > 3, "medium").otherwise("low"),
    })
    levels = F.array("sample_risk", "bias_risk", "validity_risk", "implementation_risk")
    overall = F.when(F.array_contains(levels, "high"), "high").when(F.array_contains(levels, "medium"), "medium").otherwise("low")
    return out.withColumn("overall_risk", overall).withColumn(
        "confidence", F.when(F.col("overall_risk") == "low", 0.9).when(F.col("overall_risk") == "medium", 0.7).otherwise(0.5))


def business_impact(facts: DataFrame, traffic: float = 100_000, order_value: float = 50, cost: float = 10_000) -> DataFrame:
    """Revenue of the best variant's lift at the given yearly traffic, order value and cost."""
    lift = F.coalesce(F.col("best_lift"), F.lit(0.0))
    known = F.col("control_rate").isNotNull() & F.col("best_variant").isNotNull()
    rev = F.when(known, F.lit(float(traffic)) * F.col("control_rate") * lift * order_value).otherwise(0.0)
    spent = F.when(known, F.lit(float(cost))).otherwise(0.0)
    return facts.select(
        "experiment_id", F.when(known, lift).otherwise(0.0).alias("lift"), rev.alias("revenue"), spent.alias("cost"),
        F.when(spent > 0, F.try_divide(rev - spent, spent)).otherwise(0.0).alias("roi"),
        (rev * 0.8).alias("lower"), (rev * 1.2).alias("upper"), (rev * 0.7).alias("expected"), (rev * 0.3).alias("at_risk"),
        F.when(known, F.greatest(F.lit(0.5), 1 - F.coalesce("best_p", F.lit(0.5)))).otherwise(0.5).alias("success_probability"))


def auto_decision(assessed: DataFrame, running_days: str) -> DataFrame:
    """terminate, launch_winner, or NULL (keep running); input has power and risk columns."""
    days = F.coalesce(F.col(running_days), F.lit(0.0))
    stop = ((days > 21) & (F.col("significant") == 0)) | (F.col("overall_risk") == "high")
    launch = F.col("ready_variant").isNotNull() & (F.col("power") >= POWER)
    decision = F.when(stop, "terminate").when(launch, "launch_winner")
    return assessed.select(
        "experiment_id", decision.alias("decision"), F.when(~stop & launch, F.col("ready_variant")).alias("winning_variant"),
        F.when(stop, 0.8).when(launch, 0.9).alias("confidence"), (F.col("power") >= POWER).alias("sample_adequate"))


def recommendations(facts: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Rule list per experiment, as codes."""
    rules = F.array(
        F.when(F.col("samples") < F.lit(min_sample) * F.col("variants"), "increase_sample"),
        F.when(F.col("significant") == 0, "extend_experiment").otherwise(F.concat(F.col("significant").cast("string"), F.lit("_significant"))),
        F.when(F.col("practical") == 0, "no_practical_effect"),
        F.when(F.coalesce("best_lift", F.lit(0.0)) > 0, F.concat(F.lit("implement_"), F.col("best_variant"))))
    return facts.select("experiment_id", F.array_compact(rules).alias("recommendations"))


def experiment_statistics(experiments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals; input: status, actual_days (NULL while running), decision."""
    done = F.col("status") == "completed"
    return experiments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(done).alias("completed"),
        F.coalesce(F.avg(F.when(F.col("actual_days") != 0, F.col("actual_days"))), F.lit(0.0)).alias("mean_days"),
        F.coalesce(div(F.count_if(done & (F.col("decision") == "launch_winner")), F.count_if(done)), F.lit(0.0)).alias("success_rate"))


def validate_experiments(experiments: DataFrame, variants: DataFrame, metrics: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """Errors and warnings per experiment definition.

    ``experiments``: experiment_id, planned_days; ``variants``: experiment_id,
    is_control, allocation; ``metrics``: experiment_id, is_primary.
    """
    v = variants.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("is_control").alias("_c"), F.sum("allocation").alias("_t"))
    m = metrics.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("_m"), F.count_if("is_primary").alias("_p"))
    j = experiments.join(v, "experiment_id", "left").join(m, "experiment_id", "left").na.fill(0, ["_n", "_c", "_m", "_p"]).na.fill(0.0, ["_t"])
    errors = F.array(
        F.when(F.col("_n") < 2, "variants: at least 2 needed"),
        F.when(F.col("_c") != 1, "control: exactly one needed"),
        F.when(F.round(F.abs(F.col("_t") - 1.0), 9) > 0.01, "traffic: must sum to 1"),
        F.when(F.col("_m") == 0, "metrics: at least one needed"))
    warnings = F.array(F.when(F.col("_p") == 0, "metrics: no primary one"), F.when(F.col("planned_days") > max_days, "duration: above the maximum"))
    return j.select("experiment_id", F.array_compact(errors).alias("errors"), F.array_compact(warnings).alias("warnings")).withColumn(
        "is_valid", F.size("errors") == 0)
