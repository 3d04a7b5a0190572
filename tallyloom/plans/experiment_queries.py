"""Registered queries: experiments and trajectory evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import r6
from tallyloom.operators import evals as G
from tallyloom.operators import experiments as X
from tallyloom.plans.fixtures import agent_events, oracle, table
from tallyloom.plans.session import written
from tallyloom.plans.run_queries import RUNS_CTE

QUERIES = {}
ORACLE = {}


def _add(key, run, sql=None):
    QUERIES[key] = run
    if sql is not None:
        ORACLE[key] = sql


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- sequential tests: events as observations, one experiment per event type; success = value above 30 -------

def _obs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    lift = F.when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 1), 45.0).when(
        (F.col("event_type") == "error") & (F.col("user_id") % 2 == 1), -20.0).otherwise(0.0)
    return ev.select("event_type", "event_id", F.when(F.col("user_id") % 2 == 0, "control").otherwise("variant").alias("arm"),
                     F.when(F.col("value") + lift > 30, 1.0).otherwise(0.0).alias("value"))


_OBS = ("ob AS (SELECT event_type, event_id, user_id % 2 AS arm, CASE WHEN value + CASE WHEN event_type = 'click' AND user_id % 2 = 1 THEN 45 WHEN event_type = 'error' AND user_id % 2 = 1 THEN -20 ELSE 0 END > 30 "
        "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM events)")


def _rad(n):
    return f"sqrt(0.25 * ({n} + 1) / ({n}::DOUBLE * {n}) * greatest(ln(({n} + 1) / (0.025 * 0.025)::DOUBLE), 0))"


_DEC = "CASE WHEN eff - rad > 0 THEN 'ship' WHEN eff + rad < 0 THEN 'revert' ELSE 'inconclusive' END"


def _seq(keys, nc="count(*) FILTER (WHERE arm = 0)", nv="count(*) FILTER (WHERE arm = 1)", src="ob"):
    return (f"SELECT {keys}, {nc} AS nc, {nv} AS nv, avg(value) FILTER (WHERE arm = 1) - avg(value) FILTER (WHERE arm = 0) AS eff, "
            f"{_rad(nc)} + {_rad(nv)} AS rad FROM {src} GROUP BY {keys}")


_add("E1_sequential_evaluate", lambda s, d: _rounded(X.sequential_evaluate(_obs(s, d), ["event_type"])),
     f"WITH {_OBS} SELECT event_type, round(eff, 6) AS effect, round(eff - rad, 6) AS lower, round(eff + rad, 6) AS upper, {_DEC} AS decision, nc AS n_control, nv AS n_variant FROM ({_seq('event_type')})")
def _path(spark, sf_dir):
    return X.sequential_path(_obs(spark, sf_dir), ["event_type"], ["event_id"])


_PATH = ("ps AS (SELECT event_type, arm, value, row_number() OVER (PARTITION BY event_type, arm ORDER BY event_id) AS i FROM ob), "
         "pp AS (SELECT c.event_type, c.i, sum(c.value) OVER w / c.i AS mc, sum(v.value) OVER w / c.i AS mv FROM ps c JOIN ps v ON c.event_type = v.event_type AND c.i = v.i AND c.arm = 0 AND v.arm = 1 "
         "WINDOW w AS (PARTITION BY c.event_type ORDER BY c.i)), "
         f"pt AS (SELECT event_type, i, mv - mc AS eff, 2 * {_rad('i')} AS rad FROM pp)")


def _e2(spark, sf_dir):
    path = written(_path(spark, sf_dir), "path")
    both = path.join(X.first_stop(path, ["event_type"]).select("event_type", "stopped_at"), "event_type")
    return _rounded(both.withColumn("sum_difference", F.col("effect") * F.col("i"))).select(
        "event_type", F.col("i").cast("long").alias("i"), "sum_difference", "lower", "upper", "decision", F.col("stopped_at").cast("long").alias("stopped_at"))


_add("E2_sequential_path", _e2,
     f"WITH {_OBS}, {_PATH} SELECT event_type, i, round(eff * i, 6) AS sum_difference, round(eff - rad, 6) AS lower, round(eff + rad, 6) AS upper, {_DEC} AS decision, "
     f"min(CASE WHEN {_DEC} <> 'inconclusive' THEN i END) OVER (PARTITION BY event_type) AS stopped_at FROM pt")

# the two-sided 5% and 80%-power normal quantiles, to ten digits
_Z = "(1.9599639845 + 0.8416212336)"


def _e4(spark, sf_dir):
    """One question per part: baseline from its size, effect from its price."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("baseline"), (0.01 + (F.col("p_partkey") % 20) / 200.0).alias("mde"))
    out = X.sample_size(p, "baseline", "mde")
    return out.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.min("per_arm").alias("least"), F.max("per_arm").alias("most"))


_add("E4_sample_size", _e4,
     f"SELECT b AS baseline, count(*) AS n, CAST(min(per_arm) AS BIGINT) AS least, CAST(max(per_arm) AS BIGINT) AS most FROM (SELECT b, ceil({_Z}::DOUBLE * {_Z}::DOUBLE * (b * (1 - b) + (b + d) * (1 - b - d)) / (d * d)) AS per_arm FROM "
     "(SELECT p_size / 100.0::DOUBLE AS b, 0.01::DOUBLE + (p_partkey % 20) / 200.0::DOUBLE AS d FROM part)) GROUP BY 1")


def _monitor(spark, sf_dir):
    """Experiment per user group of eight; the event types are its metrics, clicks the target."""
    ev = table(spark, sf_dir, "events")
    metric = (F.when(F.col("event_type") == "error", "override_rate").when(F.col("event_type") == "purchase", "task_success_rate")
              .when(F.col("event_type") == "signup", "cost_per_completed_task").otherwise(F.col("event_type")))
    grp = F.col("user_id") % 8
    arm = F.when(F.floor(F.col("user_id") / 8) % 2 == 0, "control").otherwise("variant")
    push = (F.when((arm == "variant") & (F.col("event_type") == "click") & (grp < 4), 60.0)
            .when((arm == "variant") & (F.col("event_type") == "error") & (grp == 1), 60.0)
            .when((arm == "variant") & (F.col("event_type") == "purchase") & (grp == 2), -60.0).otherwise(0.0))
    obs = ev.select(F.concat(F.lit("exp_"), grp.cast("string")).alias("experiment_id"), metric.alias("metric"), arm.alias("arm"), "event_id",
                    F.when(F.col("value") + push > 30, 1.0).otherwise(0.0).alias("value"))
    exps = ev.select(F.concat(F.lit("exp_"), grp.cast("string")).alias("experiment_id"), F.lit("click").alias("target_metric"),
                     F.when(grp == 3, "decrease").otherwise("increase").alias("direction")).distinct()
    return X.monitor_experiments(obs, exps)


_add("E5_monitor_experiments", lambda s, d: _rounded(_monitor(s, d).withColumn("breached", F.concat_ws(",", "breached"))),
     "WITH o AS (SELECT user_id % 8 AS g, event_type AS m, (user_id // 8) % 2 AS arm, event_id, value + CASE WHEN (user_id // 8) % 2 = 1 AND event_type = 'click' AND user_id % 8 < 4 THEN 60 "
     "WHEN (user_id // 8) % 2 = 1 AND event_type = 'error' AND user_id % 8 = 1 THEN 60 WHEN (user_id // 8) % 2 = 1 AND event_type = 'purchase' AND user_id % 8 = 2 THEN -60 ELSE 0 END AS raw FROM events), "
     "p AS (SELECT g, m, arm, CASE WHEN raw > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM o), "
     "ob AS (SELECT g, m, arm, value FROM p), "
     f"ev AS (SELECT *, eff - rad AS lo, eff + rad AS hi FROM ({_seq('g, m')})), "
     "br AS (SELECT g, string_agg(nm, ',' ORDER BY nm) AS breached FROM (SELECT g, CASE m WHEN 'error' THEN 'override_rate' WHEN 'purchase' THEN 'task_success_rate' WHEN 'signup' THEN 'cost_per_completed_task' ELSE m END AS nm "
     "FROM ev WHERE m <> 'click' AND CASE WHEN m = 'purchase' THEN hi < 0 ELSE lo > 0 END) GROUP BY 1), "
     "d AS (SELECT ev.g, coalesce(breached, '') AS breached, eff, lo, hi, nc, nv, CASE WHEN breached IS NOT NULL THEN 'revert' WHEN ev.g = 3 THEN CASE WHEN hi < 0 THEN 'ship' WHEN lo > 0 THEN 'revert' END "
     "ELSE CASE WHEN lo > 0 THEN 'ship' WHEN hi < 0 THEN 'revert' END END AS decision FROM ev LEFT JOIN br ON br.g = ev.g WHERE m = 'click') "
     "SELECT 'exp_' || g AS experiment_id, CASE WHEN breached <> '' THEN 'stopped' WHEN decision IS NULL THEN 'inconclusive' ELSE 'concluded' END AS status, decision, breached, round(eff, 6) AS effect, round(lo, 6) AS lower, "
     "round(hi, 6) AS upper, nc AS n_control, nv AS n_variant FROM d")

# ---- assignment ----------------------------------------------------------

VARIANTS = (X.Variant("a", 0.5, True), X.Variant("b", 0.3), X.Variant("c", 0.15))


def _hash(text):
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, 0::BIGINT)"


_ABS = "CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END"
_add("E6_assign_variant", lambda s, d: X.assign_variant(table(s, d, "customer").select("c_custkey", "c_name"), "checkout", VARIANTS, "c_name"),
     f"SELECT c_custkey, c_name, CASE WHEN {_ABS} / 2147483647.0::DOUBLE <= 0.5::DOUBLE THEN 'a' WHEN {_ABS} / 2147483647.0::DOUBLE <= 0.5::DOUBLE + 0.3::DOUBLE THEN 'b' "
     f"WHEN {_ABS} / 2147483647.0::DOUBLE <= 0.5::DOUBLE + 0.3::DOUBLE + 0.15::DOUBLE THEN 'c' ELSE 'a' END AS variant FROM (SELECT *, {_hash(chr(99) + '_name || ' + chr(39) + '_checkout' + chr(39))} AS h FROM customer)")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("props"))


RULES = (X.ExclusionRule("userId in 7,77,777,1234"), X.ExclusionRule("segment is MACHINERY and nation 1x"), X.ExclusionRule("segment HOUSEHOLD", False))
_add("E7_apply_exclusions", lambda s, d: X.apply_exclusions(_customers(s, d), RULES, "c_custkey", "props").select("c_custkey"),
     "SELECT c_custkey FROM customer WHERE NOT (contains('userId in 7,77,777,1234', CAST(c_custkey AS VARCHAR)) OR contains('segment is MACHINERY and nation 1x', c_mktsegment) "
     "OR contains('segment is MACHINERY and nation 1x', CAST(c_nationkey AS VARCHAR)))")
_add("E8_eligible_segments", lambda s, d: X.eligible_segments(_customers(s, d), [{"segment": "BUILDING", "nation": "3"}, {"segment": "FURNITURE"}], "props").select("c_custkey"),
     "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey = 3) OR c_mktsegment = 'FURNITURE'")

# ---- results: customers are exposed, an urgent pending order is a conversion ----

_NV = "(CASE WHEN c_nationkey % 6 = 5 THEN 4 WHEN c_nationkey % 2 = 0 THEN 2 ELSE 3 END)"


def _setup(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    exp = F.concat(F.lit("exp_"), (F.col("c_nationkey") % 6).cast("string")).alias("experiment_id")
    exposures = cust.select(exp, F.col("c_custkey").alias("user_id"), F.concat(F.lit("v"), F.expr(f"(c_custkey * 7 + c_custkey % 3) % {_NV}").cast("string")).alias("variant_id"))
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))
    conv = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(exp, F.col("c_custkey").alias("user_id"), F.col("o_totalprice").alias("value"))
    variants = exposures.select("experiment_id", "variant_id").distinct().withColumn("is_control", F.col("variant_id") == "v0")
    return exposures, conv, variants


def _results(spark, sf_dir):
    return X.variant_results(*_setup(spark, sf_dir))


_VR = (f"xp AS (SELECT 'exp_' || (c_nationkey % 6) AS e, c_custkey AS u, 'v' || ((c_custkey * 7 + c_custkey % 3) % {_NV}) AS v FROM customer), "
       "cv AS (SELECT o_custkey AS u, count(*) AS c, sum(o_totalprice) AS r FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1), "
       "ag AS (SELECT e, v, count(*) AS n, coalesce(sum(c), 0) AS c, coalesce(sum(r), 0) AS rev FROM xp LEFT JOIN cv ON cv.u = xp.u GROUP BY 1, 2), "
       "vr AS (SELECT e AS experiment_id, v AS variant_id, v = 'v0' AS is_control, n AS sample_size, CAST(c AS BIGINT) AS conversions, c / n AS rate, rev AS revenue, sqrt(greatest(c / n * (1 - c / n), 0)) AS std_dev, "
       "sqrt(greatest(c / n * (1 - c / n), 0) / n) AS std_error, n / sum(n) OVER (PARTITION BY e) AS sample_ratio, count(*) OVER (PARTITION BY e) AS k FROM ag)")
_add("E9_variant_results", lambda s, d: _rounded(_results(s, d)),
     f"WITH {_VR} SELECT experiment_id, variant_id, is_control, sample_size, conversions, round(rate, 6) AS rate, round(revenue, 6) AS revenue, round(std_dev, 6) AS std_dev, round(std_error, 6) AS std_error, "
     "round(greatest(0, rate - 1.96 * std_error), 6) AS ci_lower, round(least(1, rate + 1.96 * std_error), 6) AS ci_upper, round(CAST(sample_ratio AS DOUBLE), 6) AS sample_ratio FROM vr")
_CMP = ("cm AS (SELECT t.experiment_id, t.variant_id, t.rate - c.rate AS al, coalesce((t.rate - c.rate) / nullif(c.rate, 0), 0) AS rl, "
        "coalesce((t.rate - c.rate) / nullif(sqrt(t.std_error * t.std_error + c.std_error * c.std_error), 0), 0) AS z, t.sample_size + c.sample_size - 2 AS df "
        "FROM vr t JOIN vr c ON c.experiment_id = t.experiment_id AND c.is_control WHERE NOT t.is_control), "
        "cp AS (SELECT *, CASE WHEN abs(z) > 2.58 THEN 0.01::DOUBLE WHEN abs(z) > 1.96 THEN 0.05::DOUBLE WHEN abs(z) > 1.645 THEN 0.1::DOUBLE WHEN abs(z) > 1.28 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS p FROM cm)")
_add("E10_compare_to_control", lambda s, d: _rounded(X.compare_to_control(written(_results(s, d), "results"))),
     f"WITH {_VR}, {_CMP} SELECT experiment_id, variant_id, round(al, 6) AS absolute_lift, round(rl, 6) AS relative_lift, round(z, 6) AS z, p AS p_bucket, df AS degrees_of_freedom, p < 0.05 AS reject_null FROM cp")


def _facts(spark, sf_dir):
    res = written(_results(spark, sf_dir), "results")
    days = F.regexp_extract("experiment_id", "[0-9]+", 0).cast("int") * 6.0
    return X.experiment_power(X.experiment_facts(res, X.compare_to_control(res)), 60).withColumn("days", days)


_FACTS = ("fa AS (SELECT vr.experiment_id, count(*) AS variants, CAST(sum(sample_size) AS BIGINT) AS samples, max(abs(sample_ratio - 1.0 / k)) AS imb, count(*) FILTER (WHERE p < 0.05) AS sig, "
          "count(*) FILTER (WHERE abs(rl) >= 0.05) AS prac, max(rate) FILTER (WHERE is_control) AS cr, min(vr.variant_id) FILTER (WHERE p < 0.05 AND abs(rl) >= 0.05) AS ready, "
          "least(sum(sample_size) / (60.0 * count(*)), 1.0) AS power, CAST(regexp_extract(vr.experiment_id, '[0-9]+', 0) AS INTEGER) * 6.0 AS days FROM vr LEFT JOIN cp ON cp.experiment_id = vr.experiment_id AND cp.variant_id = vr.variant_id GROUP BY 1), "
          "bs AS (SELECT * FROM (SELECT vr.experiment_id, vr.variant_id AS bv, rl AS bl, p AS bp, row_number() OVER (PARTITION BY vr.experiment_id ORDER BY rate DESC, vr.variant_id) AS rn FROM vr JOIN cp ON cp.experiment_id = vr.experiment_id AND cp.variant_id = vr.variant_id) WHERE rn = 1), "
          "fb AS (SELECT fa.*, bv, bl, bp FROM fa LEFT JOIN bs ON bs.experiment_id = fa.experiment_id)")
XF = f"WITH {_VR}, {_CMP}, {_FACTS} "


def _e11(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return _rounded(X.pooled_sample_size(f, "control_rate", "variants")).select("experiment_id", "power", "per_variant", "total_required", F.col("days").alias("days_needed"))


_PER = f"ceil({_Z}::DOUBLE * {_Z}::DOUBLE * 2 * (cr * 2.05 / 2) * (1 - cr * 2.05 / 2) / ((cr * 0.05) * (cr * 0.05)))"
_add("E11_experiment_power", _e11, XF + f"SELECT experiment_id, round(CAST(power AS DOUBLE), 6) AS power, CAST({_PER} AS BIGINT) AS per_variant, CAST({_PER} * variants AS BIGINT) AS total_required, "
     f"CAST(ceil({_PER} * variants / 1000) AS BIGINT) AS days_needed FROM fb")
_RISK = ("rk AS (SELECT *, CASE WHEN samples < 60 * variants * 0.5 THEN 'high' WHEN samples < 60 * variants THEN 'medium' ELSE 'low' END AS sample_risk, CASE WHEN imb > 0.1 THEN 'medium' ELSE 'low' END AS bias_risk, "
         "CASE WHEN days < 7 THEN 'high' WHEN days < 14 THEN 'medium' ELSE 'low' END AS validity_risk, CASE WHEN variants > 3 THEN 'medium' ELSE 'low' END AS implementation_risk FROM fb), "
         "ro AS (SELECT *, CASE WHEN 'high' IN (sample_risk, bias_risk, validity_risk, implementation_risk) THEN 'high' WHEN 'medium' IN (sample_risk, bias_risk, validity_risk, implementation_risk) THEN 'medium' ELSE 'low' END AS overall_risk FROM rk)")


def _risk(spark, sf_dir):
    return X.risk_assessment(_facts(spark, sf_dir), "days", 60)


_add("E12_risk_assessment", lambda s, d: _risk(s, d).select("experiment_id", "sample_risk", "bias_risk", "validity_risk", "implementation_risk", "overall_risk", "confidence"),
     XF.rstrip() + f", {_RISK} SELECT experiment_id, sample_risk, bias_risk, validity_risk, implementation_risk, overall_risk, CASE overall_risk WHEN 'low' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM ro")
_REV = "(100000 * cr * bl * 50)"
_add("E13_business_impact", lambda s, d: _rounded(X.business_impact(_facts(s, d))),
     XF + f"SELECT experiment_id, round(bl, 6) AS lift, round({_REV}, 6) AS revenue, 10000.0::DOUBLE AS cost, round(({_REV} - 10000) / 10000, 6) AS roi, round({_REV} * 0.8, 6) AS lower, round({_REV} * 1.2, 6) AS upper, "
     f"round({_REV} * 0.7, 6) AS expected, round({_REV} * 0.3, 6) AS at_risk, greatest(0.5::DOUBLE, 1 - bp) AS success_probability FROM fb")
_add("E14_auto_decision", lambda s, d: X.auto_decision(_risk(s, d), "days"),
     XF.rstrip() + f", {_RISK}, dc AS (SELECT *, (days > 21 AND sig = 0) OR overall_risk = 'high' AS stop, ready IS NOT NULL AND power >= 0.8 AS launch FROM ro) "
     "SELECT experiment_id, CASE WHEN stop THEN 'terminate' WHEN launch THEN 'launch_winner' END AS decision, CASE WHEN NOT stop AND launch THEN ready END AS winning_variant, "
     "CASE WHEN stop THEN 0.8::DOUBLE WHEN launch THEN 0.9::DOUBLE END AS confidence, power >= 0.8 AS sample_adequate FROM dc")
_add("E15_recommendations", lambda s, d: X.recommendations(_facts(s, d), 60).withColumn("recommendations", F.concat_ws(";", "recommendations")),
     XF + "SELECT experiment_id, concat_ws(';', CASE WHEN samples < 60 * variants THEN 'increase_sample' END, CASE WHEN sig = 0 THEN 'extend_experiment' ELSE sig || '_significant' END, "
     "CASE WHEN prac = 0 THEN 'no_practical_effect' END, CASE WHEN bl > 0 THEN 'implement_' || bv END) AS recommendations FROM fb")


def _e16(spark, sf_dir):
    """Orders as experiments, by priority: finished ones have a duration and maybe a launch."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("draft").alias("status"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_custkey") % 30).cast("double")).alias("actual_days"),
        F.when(F.col("o_totalprice") > 200000, "launch_winner").otherwise("terminate").alias("decision"))
    return _rounded(X.experiment_statistics(o, ["o_orderpriority"]))


_add("E16_experiment_statistics", _e16,
     "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, "
     "round(avg(o_custkey % 30) FILTER (WHERE o_orderstatus = 'F' AND o_custkey % 30 <> 0), 6) AS mean_days, "
     "round(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000) / count(*) FILTER (WHERE o_orderstatus = 'F'), 6) AS success_rate FROM orders GROUP BY 1")


def _e17(spark, sf_dir):
    """Orders as definitions: line items are variants, discounted ones carry the metrics."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experiment_id"), (F.col("o_custkey") % 45).alias("planned_days"))
    li = table(spark, sf_dir, "lineitem")
    v = li.select(F.col("l_orderkey").alias("experiment_id"), (F.col("l_linenumber") == 1).alias("is_control"), (F.col("l_quantity") / 100.0).alias("allocation"))
    m = li.where(F.col("l_discount") > 0.07).select(F.col("l_orderkey").alias("experiment_id"), (F.col("l_tax") > 0.04).alias("is_primary"))
    return X.validate_experiments(o, v, m).select("experiment_id", F.concat_ws(";", "errors").alias("errors"), F.concat_ws(";", "warnings").alias("warnings"), "is_valid")


_add("E17_validate_experiments", _e17,
     "WITH v AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 1) AS c, sum(l_quantity / 100) AS t, count(*) FILTER (WHERE l_discount > 0.07::DOUBLE) AS m, "
     "count(*) FILTER (WHERE l_discount > 0.07::DOUBLE AND l_tax > 0.04::DOUBLE) AS p FROM lineitem GROUP BY 1), "
     "j AS (SELECT o_orderkey, o_custkey % 45 AS d, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(t, 0) AS t, coalesce(m, 0) AS m, coalesce(p, 0) AS p FROM orders LEFT JOIN v ON k = o_orderkey), "
     "e AS (SELECT o_orderkey, concat_ws(';', CASE WHEN n < 2 THEN 'variants: at least 2 needed' END, CASE WHEN c <> 1 THEN 'control: exactly one needed' END, "
     "CASE WHEN round(abs(t - 1), 9) > 0.01 THEN 'traffic: must sum to 1' END, CASE WHEN m = 0 THEN 'metrics: at least one needed' END) AS errors, "
     "concat_ws(';', CASE WHEN p = 0 THEN 'metrics: no primary one' END, CASE WHEN d > 30 THEN 'duration: above the maximum' END) AS warnings FROM j) "
     "SELECT o_orderkey AS experiment_id, errors, warnings, errors = '' AS is_valid FROM e")

# ---- trajectories --------------------------------------------------------


def _facts_g(spark, sf_dir):
    return G.trajectory_facts(agent_events(spark, sf_dir))


def _one(scorer):
    return lambda s, d: _rounded(G.score_runs(_facts_g(s, d), [scorer])).select("tenant_id", "task_id", "run_id", "value", "label")


_SCORE_SQL = {
    "task_completed": ("CASE WHEN outcome = 'completed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "CAST(NULL AS VARCHAR)"),
    "clean_trajectory": ("CASE WHEN outcome = 'completed' AND errors = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
                         "CASE WHEN outcome <> 'completed' THEN 'not_completed' WHEN errors > 0 THEN 'failed_steps:' || errors END"),
    "low_retry_churn": ("CASE WHEN steps = 0 THEN 1.0::DOUBLE ELSE round(greatest(0, 1 - retries / steps), 6) END", "CASE WHEN steps = 0 THEN 'no_steps' END"),
    "no_human_intervention": ("CASE WHEN intervened THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END", "CAST(NULL AS VARCHAR)"),
}
for _i, (_name, (_v, _l)) in enumerate(_SCORE_SQL.items(), start=1):
    _add(f"G{_i}_score_{_name}", _one(_name), oracle(f"SELECT tenant_id, task_id, run_id, {_v} AS value, {_l} AS label FROM runs", RUNS_CTE))

VERSIONS = {"prompt_version": "p1", "model_version": "m1", "agent_version": "1.1.0"}


def _suite(spark, sf_dir):
    """Each tenant's runs are its dataset; the case is the run."""
    ev = agent_events(spark, sf_dir)
    ds = ev.select("tenant_id", "task_id", "run_id").distinct().select(
        "tenant_id", "task_id", "run_id", F.concat(F.lit("ds_"), "tenant_id").alias("dataset_id"), F.lit("1").alias("dataset_version"),
        F.concat_ws("/", "task_id", "run_id").alias("case_id"))
    return G.run_suite(ds, ev, VERSIONS)


_SCORED = "sc AS (" + " UNION ALL ".join(f"SELECT tenant_id, task_id, run_id, '{n}' AS scorer_id, {v} AS value FROM runs" for n, (v, _) in _SCORE_SQL.items()) + ")"
_add("G5_run_suite", lambda s, d: _rounded(G.suite_means(_suite(s, d))),
     oracle("SELECT 'ds_' || tenant_id AS dataset_id, scorer_id, round(avg(value), 6) AS mean, count(*) AS cases FROM sc GROUP BY tenant_id, scorer_id", RUNS_CTE, _SCORED))
GATE = {"task_completed": 0.3, "clean_trajectory": 0.35, "low_retry_churn": 0.8}


def _g6(spark, sf_dir):
    sc = _suite(spark, sf_dir)
    bad = G.failing_cases(sc, GATE).groupBy("dataset_id", "scorer_id").agg(F.count(F.lit(1)).alias("failing"), F.min("case_id").alias("first_failing"))
    return _rounded(G.evaluate_gate(sc, GATE).join(bad, ["dataset_id", "scorer_id"], "left"))


_add("G6_evaluate_gate", _g6, oracle(
    "SELECT 'ds_' || tenant_id AS dataset_id, sc.scorer_id, round(avg(value), 6) AS mean, count(*) AS cases, m AS min_mean, avg(value) >= m AS passed, "
    "CASE WHEN avg(value) < m THEN nullif(count(*) FILTER (WHERE value < m), 0) END AS failing, CASE WHEN avg(value) < m THEN min(task_id || '/' || run_id) FILTER (WHERE value < m) END AS first_failing "
    "FROM sc JOIN th ON th.scorer_id = sc.scorer_id GROUP BY tenant_id, sc.scorer_id, m", RUNS_CTE, _SCORED,
    "th(scorer_id, m) AS (VALUES ('task_completed', 0.3::DOUBLE), ('clean_trajectory', 0.35::DOUBLE), ('low_retry_churn', 0.8::DOUBLE))"))


def _g7(spark, sf_dir):
    """Humans rate the documents twice, the judge once: the later human rating counts, which is the first for every fourth document."""
    lab = table(spark, sf_dir, "labels")
    judge = lab.select("doc_id", F.lit("judge").alias("kind"), F.lit(1).alias("seq"), (0.9 - F.col("toxic") * 0.4 - (F.col("doc_id") % 5) * 0.05).alias("value"))
    h1 = lab.select("doc_id", F.lit("human").alias("kind"), F.lit(1).alias("seq"), F.lit(0.0).alias("value"))
    h2 = lab.select("doc_id", F.lit("human").alias("kind"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(2).alias("seq"), F.col("quality").cast("double").alias("value"))
    src = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return _rounded(G.judge_agreement(judge.unionByName(h1).unionByName(h2).join(src, "doc_id"), ["doc_id"], "seq", by=["lang"]))


_add("G7_judge_agreement", _g7,
     "SELECT lang, count(*) AS pairs, round(count(*) FILTER (WHERE round(abs((0.9 - toxic * 0.4 - (l.doc_id % 5) * 0.05) - CASE WHEN l.doc_id % 4 <> 0 THEN quality ELSE 0 END), 12) <= 0.25) / count(*), 6) AS agreement "
     "FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1")
_add("G8_sample_traces", lambda s, d: G.sample_traces(agent_events(s, d).select("task_id", "run_id").distinct(), F.concat_ws(":", "task_id", "run_id"), 0.4),
     oracle(f"SELECT task_id, run_id FROM (SELECT DISTINCT task_id, run_id FROM agent_events) WHERE {_hash(chr(116) + 'ask_id || ' + chr(39) + ':' + chr(39) + ' || run_id')} / 4294967295.0::DOUBLE < 0.4::DOUBLE"))


def _g9(spark, sf_dir):
    """Two user scorers: share of fast steps, and share of tokens spent in successful steps."""
    step = F.col("event") == "step_executed"
    ok = step & (F.col("status") == "ok")
    tok = F.col("tokens_in") + F.col("tokens_out")
    scorers = {
        "fast_steps": lambda: F.coalesce(F.try_divide(F.count_if(step & (F.col("latency_ms") < 300)), F.count_if(step)), F.lit(1.0)),
        "tokens_well_spent": lambda: F.coalesce(F.try_divide(F.sum(F.when(ok, tok)), F.sum(F.when(step, tok))), F.lit(1.0)),
    }
    return _rounded(G.custom_scores(agent_events(spark, sf_dir), scorers)).drop("kind")


_add("G9_custom_scorers", _g9, oracle(
    "SELECT tenant_id, task_id, run_id, 'fast_steps' AS scorer_id, round(coalesce(count(*) FILTER (WHERE event = 'step_executed' AND latency_ms < 300) / nullif(count(*) FILTER (WHERE event = 'step_executed'), 0), 1), 6) AS value "
    "FROM agent_events GROUP BY 1, 2, 3 UNION ALL SELECT tenant_id, task_id, run_id, 'tokens_well_spent', round(coalesce(sum(tokens_in + tokens_out) FILTER (WHERE event = 'step_executed' AND status = 'ok') "
    "/ nullif(sum(tokens_in + tokens_out) FILTER (WHERE event = 'step_executed'), 0), 1), 6) FROM agent_events GROUP BY 1, 2, 3"))
