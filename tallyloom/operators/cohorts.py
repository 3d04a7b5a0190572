"""Cohorts over product events: membership, period activity, retention, health."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import div, sunday_week
from tallyloom.operators.funnels import Condition, step_condition

# Period lengths in microseconds; a month is 30 days.
UNIT_US = {"day": 86_400_000_000, "week": 7 * 86_400_000_000, "month": 30 * 86_400_000_000}
DEFAULT_PERIODS = 12


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def cohort_key(ts: Column, unit: str) -> Column:
    if unit == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "week":
        return F.concat(F.lit("Week of "), F.date_format(sunday_week(ts), "yyyy-MM-dd"))
    if unit == "month":
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(f"unknown time unit: {unit}")


def cohort_users(events: DataFrame, unit: str = "week", event_type: str | None = None, where: Sequence[Condition] = (),
                 keep: Sequence[str] = (), user: str = "user_id", ts: str = "ts", type_col: str = "event_type") -> DataFrame:
    """First qualifying event per user and the cohort it falls in; ``keep`` carries columns of that event."""
    q = events
    if event_type is not None:
        q = q.where(F.col(type_col) == event_type)
    for c in where:
        q = q.where(step_condition(c))
    first = q.groupBy(user).agg(F.min(ts).alias("cohort_date"), *[F.min_by(c, ts).alias(c) for c in keep])
    return first.withColumn("cohort", cohort_key(F.col("cohort_date"), unit))


def period_activity(events: DataFrame, cohort: DataFrame, unit: str = "week", user: str = "user_id", ts: str = "ts",
                    type_col: str = "event_type", amount: str = "value", extra: Sequence[Column] = (), parts: Sequence[Column] = ()) -> DataFrame:
    """Per cohort user and period since joining: events, purchase revenue, engagement score.

    ``parts`` are further keys; ``whole_periods`` adds such rows up again.

    The events are never gathered per user: one equi-join against one row per
    user (a skewed user is split by adaptive skew join), then partial sums.
    """
    c = cohort.select(F.col(user).alias("_u"), "cohort", "cohort_date")
    joined = events.join(c, F.col(user) == F.col("_u")).where(F.col(ts) >= F.col("cohort_date"))
    period = F.floor((_us(ts) - _us("cohort_date")) / F.lit(UNIT_US[unit])).cast("int")
    revenue = F.sum(F.when((F.col(type_col) == "purchase"), F.col(amount)).otherwise(0.0))
    out = joined.groupBy(user, "cohort", period.alias("period"), *parts).agg(
        F.count(F.lit(1)).alias("events"), revenue.alias("revenue"), *extra)
    return out.withColumn("engagement", _engagement())


def _engagement() -> Column:
    return F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("events") / 10.0) + F.when(F.col("revenue") > 0, 0.2).otherwise(0.0))


def whole_periods(activity: DataFrame, user: str = "user_id") -> DataFrame:
    """Activity by period from rows that are cut further, each of them the last version of its part."""
    out = activity.groupBy(user, "cohort", "period").agg(F.sum("events").alias("events"), F.sum("revenue").alias("revenue"))
    return out.withColumn("engagement", _engagement())


def _dense(sizes: DataFrame, by: Sequence[str], activity: DataFrame, periods: int) -> DataFrame:
    grid = sizes.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    active = activity.groupBy(*by, "period").agg(F.count(F.lit(1)).alias("active"))
    return grid.join(active, [*by, "period"], "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long")))


def cohort_retention(cohort: DataFrame, activity: DataFrame, periods: int = DEFAULT_PERIODS) -> DataFrame:
    """Share of each cohort active in periods 0..N-1; activity has one row per (user, period), so rows are users."""
    sizes = cohort.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    return _dense(sizes, ["cohort"], activity, periods).withColumn("retention", div(F.col("active"), F.col("size")))


def retention_curve(cohort: DataFrame, activity: DataFrame, periods: int = DEFAULT_PERIODS) -> DataFrame:
    sizes = cohort.agg(F.count(F.lit(1)).alias("users")).withColumn("_g", F.lit(1))
    out = _dense(sizes, ["_g"], activity.withColumn("_g", F.lit(1)), periods)
    confidence = F.when(F.col("users") < 100, 0.6).when(F.col("users") < 1000, 0.8).otherwise(0.95)
    return out.select("period", "users", "active", F.coalesce(div(F.col("active"), F.col("users")), F.lit(0.0)).alias("retention"),
                      confidence.alias("confidence"))


def retention_by_segment(cohort: DataFrame, activity: DataFrame, segment: str, periods: int = DEFAULT_PERIODS,
                         user: str = "user_id") -> DataFrame:
    sizes = cohort.groupBy(segment).agg(F.count(F.lit(1)).alias("users"))
    tagged = activity.join(cohort.select(user, segment), user)
    return _dense(sizes, [segment], tagged, periods).withColumn("retention", div(F.col("active"), F.col("users")))


def trend(recent: Column, earlier: Column) -> Column:
    return F.when(recent > earlier * 1.05, "improving").when(recent < earlier * 0.95, "declining").otherwise("stable")


def cohort_summary(retention: DataFrame) -> DataFrame:
    """Totals, mean period-1 retention and trend of the last three cohorts against the first three."""
    p1 = retention.where(F.col("period") == 1).withColumn("_g", F.lit(1))
    w = Window.partitionBy("_g")
    ranked = p1.withColumn("_up", F.row_number().over(w.orderBy("cohort"))).withColumn(
        "_down", F.row_number().over(w.orderBy(F.desc("cohort"))))
    agg = ranked.agg(
        F.count(F.lit(1)).alias("cohorts"), F.sum("size").alias("total_users"), F.avg("retention").alias("mean_retention"),
        F.avg(F.when(F.col("_down") <= 3, F.col("retention"))).alias("_recent"),
        F.avg(F.when(F.col("_up") <= 3, F.col("retention"))).alias("_older"))
    label = F.when(F.col("cohorts") < 2, "stable").otherwise(trend(F.col("_recent"), F.col("_older")))
    return agg.select("cohorts", "total_users", "mean_retention", label.alias("trend"))


def user_engagement(cohort: DataFrame, activity: DataFrame, user: str = "user_id") -> DataFrame:
    """Mean engagement per user over their active periods, 0 without any.

    Rounded to nine digits: the last bits of a distributed mean depend on the
    order of addition, and the 0.3, 0.7 and 0.1-wide bounds must not.
    """
    per = activity.groupBy(user).agg(F.avg("engagement").alias("engagement"), F.sum("revenue").alias("revenue"))
    return cohort.join(per, user, "left").select(
        user, "cohort", F.round(F.coalesce("engagement", F.lit(0.0)), 9).alias("engagement"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def cohort_performance(cohort: DataFrame, activity: DataFrame, periods: int = DEFAULT_PERIODS, user: str = "user_id") -> DataFrame:
    """Per cohort: period-1 retention, trend over its periods, revenue, revenue per user, engagement."""
    r = F.col("retention")
    shape = cohort_retention(cohort, activity, periods).groupBy("cohort").agg(
        F.max(F.when(F.col("period") == 1, r)).alias("retention_1"),
        F.avg(F.when(F.col("period") >= periods - 3, r)).alias("_recent"),
        F.avg(F.when(F.col("period") < 3, r)).alias("_older"))
    label = trend(F.col("_recent"), F.col("_older")) if periods >= 3 else F.lit("stable")
    money = user_engagement(cohort, activity, user).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("size"), F.sum("revenue").alias("revenue"), F.avg("engagement").alias("engagement"))
    return shape.join(money, "cohort").select(
        "cohort", "size", F.coalesce("retention_1", F.lit(0.0)).alias("retention_1"), label.alias("trend"), "revenue",
        div(F.col("revenue"), F.col("size")).alias("ltv"), "engagement")


def acquisition_top(cohort: DataFrame, dims: Sequence[str] = ("source", "medium", "campaign"), n: int = 5) -> DataFrame:
    """Top values of each acquisition column per cohort with their share of its users."""
    sizes = cohort.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    long = cohort.select("cohort", *[F.col(d).cast("string").alias(d) for d in dims]).unpivot(["cohort"], list(dims), "dimension", "name")
    counts = long.where(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("cohort", "dimension", "name").agg(
        F.count(F.lit(1)).alias("users"))
    w = Window.partitionBy("cohort", "dimension").orderBy(F.desc("users"), "name")
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(sizes, "cohort")
            .select("cohort", "dimension", "rank", "name", "users", div(F.col("users"), F.col("size")).alias("share")))


def cohort_engagement(cohort: DataFrame, activity: DataFrame, user: str = "user_id") -> DataFrame:
    """Mean, users above 0.7 and below 0.3 per cohort."""
    e = F.col("engagement")
    return user_engagement(cohort, activity, user).groupBy("cohort").agg(
        F.avg(e).alias("mean_engagement"), F.count_if(e > 0.7).alias("high_users"), F.count_if(e < 0.3).alias("low_users"))


def engagement_histogram(cohort: DataFrame, activity: DataFrame, user: str = "user_id") -> DataFrame:
    bucket = F.floor(F.col("engagement") * 10) / 10.0
    return user_engagement(cohort, activity, user).groupBy("cohort", bucket.alias("score")).agg(F.count(F.lit(1)).alias("users"))


def compare_cohorts(performance: DataFrame, set_col: str, metric: str = "retention") -> DataFrame:
    """Mean of one metric over the cohorts of each set; ``performance`` is C8 output with a set column."""
    col = {"retention": "retention_1", "revenue": "ltv", "engagement": "engagement"}.get(metric)
    if col is None:
        raise ValueError(f"unknown metric: {metric}")
    return performance.groupBy(set_col).agg(F.avg(col).alias("performance")).withColumn("metric", F.lit(metric))


def cohort_health(performance: DataFrame, by: Sequence[str] = (), revenue_score: float = 75.0) -> DataFrame:
    """Mean of the retention, revenue and engagement scores, its grade and the churn risk.

    The revenue score has no definition in the source model; it is a parameter.
    """
    out = performance.groupBy(*by).agg(
        F.least(F.avg("retention_1") * 100, F.lit(100.0)).alias("retention_health"),
        (F.avg("engagement") * 100).alias("engagement_health")).withColumn("revenue_health", F.lit(float(revenue_score)))
    total = (F.col("retention_health") + F.col("revenue_health") + F.col("engagement_health")) / 3
    out = out.withColumn("overall", total)
    o = F.col("overall")
    return out.withColumn("grade", F.when(o >= 80, "excellent").when(o >= 60, "good").when(o >= 40, "warning").otherwise("critical")).withColumn(
        "churn_risk", F.when(o < 50, "high").when(o < 70, "medium").otherwise("low"))


@dataclass(frozen=True)
class CustomMetric:
    id: str
    event_type: str
    aggregation: str
    property: str | None = None
    filters: tuple[Condition, ...] = ()


def custom_metrics(events: DataFrame, cohort: DataFrame, metrics: Sequence[CustomMetric], unit: str = "week",
                   user: str = "user_id", ts: str = "ts", type_col: str = "event_type", properties: str = "props") -> DataFrame:
    """User-defined aggregates per cohort and period, compiled to built-in aggregates of one grouping."""
    c = cohort.select(F.col(user).alias("_u"), "cohort", "cohort_date")
    joined = events.join(c, F.col(user) == F.col("_u")).where(F.col(ts) >= F.col("cohort_date"))
    period = F.floor((_us(ts) - _us("cohort_date")) / F.lit(UNIT_US[unit])).cast("int")
    aggs = []
    for m in metrics:
        hit = F.col(type_col) == m.event_type
        for f in m.filters:
            hit = hit & step_condition(f, properties)
        value = None
        if m.property is not None:
            value = (F.get_json_object(properties, "$." + m.property[11:]) if m.property.startswith("properties.") else F.col(m.property))
        if m.aggregation == "count":
            agg = F.count_if(hit).cast("double")
        elif m.aggregation == "sum":
            agg = F.coalesce(F.sum(F.when(hit, value.try_cast("double"))), F.lit(0.0))
        elif m.aggregation == "average":
            agg = F.avg(F.when(hit, value.try_cast("double")))
        elif m.aggregation == "unique":
            agg = F.countDistinct(F.when(hit, value.cast("string"))).cast("double")
        else:
            raise ValueError(f"unknown aggregation: {m.aggregation}")
        aggs.append(agg.alias(m.id))
    return joined.groupBy("cohort", period.alias("period")).agg(*aggs)
