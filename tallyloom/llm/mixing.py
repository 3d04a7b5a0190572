"""Mixing sources to target weights by hash-threshold histograms.

Each document has a place on a hash axis. Words are summed by source and bucket
of that axis; running sums show in which bucket a source's budget ends. Only the
rows of that bucket are summed again over finer buckets, and last of all place by
place. What the mix takes then follows from comparing a row's place with its
source's threshold; no source is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.common import WORD_CLASS, small_side, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
BUCKET_DIGITS, LEVELS = 3, 2  # hexadecimal digits of the place per level
_AFTER_DIGITS = "g"  # sorts behind each hexadecimal digit


def document_size() -> Column:
    """Words of the text, as long; a null text has none."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)).cast("long"), F.lit(0).cast("long"))


def place() -> Column:
    """Where a row stands on its source's axis: 16 hexadecimal digits from its id and text."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.substring(F.md5(key), 1, 16)


def _source_key() -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size and target, one row per source.

    Weights go round over the sources in code point order, a null source last.
    A target stops at ``most`` times its source's size and the excess goes to the
    others by weight. In order of room per weight the sources that stop come
    first, so the level of the others follows from sums over those before them.
    """
    listed = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_of = by_room.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    per = per.select(
        "source", "source_size", "weight", "cap",
        (F.lit(share) * F.sum("source_size").over(all_of)).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("spent"),
        (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    per = per.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("weight_left"))
    per = per.withColumn("stops", F.col("cap").cast("double") <= F.col("level") * F.col("weight"))
    # levels fall from the first source that does not stop, and that one's is the level of all after it
    per = per.withColumn("level", F.max(F.when(~F.col("stops"), F.col("level"))).over(all_of))
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, targets: DataFrame, digits: int = BUCKET_DIGITS, levels: int = LEVELS) -> DataFrame:
    """source, source_size, target, whole and until, one row per source.

    Each row of a source gives ``whole`` copies, and one more if its place is
    below ``until``. The place at which the budget ends is in if that brings the
    sum nearer to the target. ``sized`` has source, size and place.
    """
    keyed = sized.select(_source_key().alias("key"), "size", "place")
    whole = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    plan = targets.withColumn("key", _source_key()).withColumn("whole", whole)
    left = plan.select("key", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)).alias("rest"))

    def crossed(rows, bucket):
        """Of each source the bucket in which its budget ends, and what is left of the budget there."""
        sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).join(left, "key")
        return sums.where("before <= rest AND rest < before + words").withColumn("rest", F.col("rest") - F.col("before"))

    rows = keyed
    for level in range(1, levels + 1):
        bucket = F.substring("place", 1, level * digits)
        left = stored(crossed(rows, bucket).select("key", "rest", "bucket"), "budget")
        ends = left.select("key", "bucket")
        rows = keyed.join(small_side(ends, ends.count()), [keyed["key"] == ends["key"], bucket == ends["bucket"]], "left_semi")
        left = left.select("key", "rest")
    nearer = F.col("rest") > F.col("words") - F.col("rest")
    ends = crossed(rows, F.col("place")).select("key", F.concat("bucket", F.when(nearer, F.lit(_AFTER_DIGITS)).otherwise(F.lit(""))).alias("until"))
    return plan.join(ends, "key", "left").drop("key")


def _copies(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (source, place, ...) with their source's plan and ``copies``."""
    keyed = plan.select(_source_key().alias("_mix_key"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), F.col("whole").alias("_mix_whole"), F.col("until").alias("_mix_until"))
    extra = F.coalesce((F.col("_mix_place") < F.col("_mix_until")).cast("int"), F.lit(0))
    return (
        rows.withColumn("_mix_key", _source_key())
        .join(small_side(keyed, keyed.count(), 100_000), "_mix_key")
        .withColumn("_mix_copies", (F.col("_mix_whole") + extra).cast("long"))
    )


def _plan(docs: DataFrame, weights, share, most) -> tuple[DataFrame, DataFrame]:
    sized = stored(docs.select("doc_id", "source", document_size().alias("size"), place().alias("place")), "sized")
    return sized, stored(mix_plan(sized, source_targets(sized, weights, share, most)), "mix-plan")


def mix_sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken (words, repeats counted).

    A row is taken as a whole, once or more. Rows with equal id and text have
    equal places and are taken alike. A null source is a source of its own, a
    null or empty text has size 0, a source of size 0 has target 0. An empty
    table gives no rows; other columns are ignored. Reruns agree.
    """
    sized, plan = _plan(docs, weights, share, most)
    mixed = _copies(plan, sized.withColumnRenamed("place", "_mix_place"))
    return mixed.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("size") * F.col("_mix_copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed table: rows of ``docs`` with all their columns, each as often as the mix takes it."""
    _, plan = _plan(docs, weights, share, most)
    mixed = _copies(plan, docs.withColumn("_mix_place", place()))
    times = F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int"))
    return mixed.withColumn("_mix_copy", F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])
