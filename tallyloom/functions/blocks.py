"""Running aggregates that split one long group over many tasks.

A window partitioned by the group alone puts the whole group in one task. Here
the order axis is cut in blocks (a monotone function of the order column). The
rows of a block are ranked or summed locally; what came before the block is
carried in from a table with one row per (group, block). The results equal the
plain window; a group with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.session import written

NUMBERS_PER_BLOCK = 65536
ROWS_PER_BLOCK = 32768


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The rows in blocks of at most ``rows_per_block``, cut by counts and not by the calendar.

    A range exchange on (keys, order) gives every partition a like share of the
    rows, however dense a group or a moment is; consecutive rows of a partition
    then make a block. Adds ``_key`` (the keys as one struct, in which nulls are
    equal), ``_pos`` (ascending in the order) and ``_block`` (ascending, and a
    run of consecutive rows in each group). The rows are written to the shared
    folder, as positions must not change when a task is run again.
    """
    rows = df.withColumn("_key", F.struct(*keys))
    rows = rows.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    rows = rows.withColumn("_pos", F.monotonically_increasing_id())
    return written(rows.withColumn("_block", F.floor(F.col("_pos") / rows_per_block)), "blocks")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", facts: dict[str, Column] | None = None,
             rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add the 1-based position of each row in its group, and what ``facts`` says of the whole group.

    Blocks are cut by counts, so a group of any size and density is spread. The
    rows are sorted once, by the cut; a position is then a difference. ``facts``
    are aggregates that can be folded by their maximum.
    """
    facts = facts or {}
    rows = cut(df, keys, order, rows_per_block)
    per = rows.groupBy("_key", "_block").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"), *[a.alias(f"_f_{n}") for n, a in facts.items()])
    whole, before = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(
        F.col("_key").alias("_of"), F.col("_block").alias("_in"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *[F.max(f"_f_{n}").over(whole).alias(n) for n in facts])
    both = rows.join(carry, (F.col("_key") == F.col("_of")) & (F.col("_block") == F.col("_in")))
    return both.select(*df.columns, *facts, (F.col("_pos") + F.col("_shift")).alias(name))


def block_of(df: DataFrame, order: str) -> Column:
    """Default block: the month of a date or timestamp, else 65536 consecutive numbers."""
    kind = dict(df.dtypes)[order]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.date_format(F.col(order), "yyyy-MM")
    return F.floor(F.col(order) / F.lit(NUMBERS_PER_BLOCK))


def _carry_join(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = carry.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_block").alias("_c_block"),
        *[c for c in carry.columns if c not in (*keys, "_block")])
    cond = F.col("_block") == F.col("_c_block")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return df.join(renamed, cond).drop("_c_block", *[f"_c_{k}" for k in keys])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in its group."""
    keys = list(keys)
    rows = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_bn"))
        .select(*keys, "_block", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_before"))
    )
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        _carry_join(rows.withColumn("_rn", F.row_number().over(local)), carry, keys)
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_before", "_rn", "_block")
    )


def side_moments(df: DataFrame, keys: Sequence[str], order: str, value: str, prefix: str,
                 later: bool = False, block: Column | None = None) -> DataFrame:
    """Count, mean, population deviation, smallest and largest value of one side of each row.

    The side is every strictly earlier row, or with ``later=True`` the row
    itself and every later one; NULL values do not count. Sums are taken about
    the series mean, so large levels do not cancel the variance away, and a
    constant side is recognised exactly by its smallest and largest value.
    """
    keys = list(keys)
    p = prefix
    rows = df.withColumn("_block", block if block is not None else block_of(df, order))
    v = F.col(value)
    over_blocks = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if later else F.col("_block").asc())
    over_blocks = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    summary = rows.groupBy(*keys, "_block").agg(
        F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    summary = summary.withColumn(
        "_shift", F.try_divide(F.sum(F.col("_n") * F.col("_m")).over(whole), F.sum("_n").over(whole).cast("double")))
    d = F.col("_m") - F.col("_shift")
    carry = summary.select(
        *keys, "_block", "_shift",
        F.sum("_n").over(over_blocks).alias("_pn"),
        F.sum(F.col("_n") * d).over(over_blocks).alias("_p1"),
        F.sum(F.col("_n") * (F.col("_v") + d * d)).over(over_blocks).alias("_p2"),
        F.min("_lo").over(over_blocks).alias("_plo"),
        F.max("_hi").over(over_blocks).alias("_phi"),
    )
    joined = _carry_join(rows, carry, keys).withColumn("_x", v - F.col("_shift"))
    local = Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc() if later else F.col(order).asc())
    local = local.rowsBetween(Window.unboundedPreceding, 0 if later else -1)
    zero = F.lit(0.0)
    n = F.coalesce(F.col("_pn"), F.lit(0)) + F.count("_x").over(local)
    s1 = F.coalesce(F.col("_p1"), zero) + F.coalesce(F.sum("_x").over(local), zero)
    s2 = F.coalesce(F.col("_p2"), zero) + F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(local), zero)
    staged = joined.select(
        *df.columns, "_shift", n.alias(f"{p}_n"), s1.alias("_s1"), s2.alias("_s2"),
        F.least(F.col("_plo"), F.min(v).over(local)).alias(f"{p}_lo"),
        F.greatest(F.col("_phi"), F.max(v).over(local)).alias(f"{p}_hi"),
    )
    nn = F.col(f"{p}_n").cast("double")
    centre = F.try_divide(F.col("_s1"), nn)
    var = F.greatest(F.try_divide(F.col("_s2"), nn) - centre * centre, zero)
    constant = F.col(f"{p}_lo") == F.col(f"{p}_hi")
    return staged.select(
        *df.columns, f"{p}_n", f"{p}_lo", f"{p}_hi",
        F.when(constant, F.col(f"{p}_lo")).otherwise(F.col("_shift") + centre).alias(f"{p}_mean"),
        F.when(constant, zero).otherwise(F.sqrt(var)).alias(f"{p}_std"),
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], block: Column | None = None) -> DataFrame:
    """Add ``sum_<value>``: the sum of each value up to and with the row, missing ones as zero. All values share one pass."""
    keys = list(keys)
    rows = written(df.withColumn("_block", block if block is not None else block_of(df, order)), "running")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    carry = per.select(*keys, "_block", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values])
    local = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = _carry_join(rows.withColumns({f"_l_{v}": F.coalesce(F.sum(v).over(local), F.lit(0)) for v in values}), carry, keys)
    return both.select(*df.columns, *[(F.col(f"_b_{v}") + F.col(f"_l_{v}")).alias(f"sum_{v}") for v in values])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``prev_<col>`` of the preceding row of the group (NULL on its first row). Blocks are cut by counts."""
    rows = cut(df, keys, order, rows_per_block)
    packed = F.struct(*cols)
    carry = rows.groupBy("_key", "_block").agg(F.max_by(packed, "_pos").alias("_last")).select(
        F.col("_key").alias("_of"), F.col("_block").alias("_in"), F.lag("_last").over(Window.partitionBy("_key").orderBy("_block")).alias("_carried"))
    local = rows.withColumn("_prev", F.lag(packed).over(Window.partitionBy("_key", "_block").orderBy("_pos")))
    out = local.join(carry, (F.col("_key") == F.col("_of")) & (F.col("_block") == F.col("_in")))
    prev = F.coalesce("_prev", "_carried")
    return out.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in cols])


def with_lookback(df: DataFrame, ts_us: str, width_us: int, lookback_us: int) -> DataFrame:
    """Cut time in blocks and copy into each block the rows its first rows still look back to.

    Adds ``_block`` and ``_copy``. A trailing window of ``lookback_us``, taken
    per (group, ``_block``), then sees exactly the rows it would see in the
    whole group; drop the rows with ``_copy`` afterwards.
    """
    own = F.floor(F.col(ts_us) / F.lit(width_us)).cast("long")
    reach = F.floor((F.col(ts_us) + F.lit(lookback_us)) / F.lit(width_us)).cast("long")
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, reach)))
    return spread.withColumn("_copy", F.col("_block") != F.col("_own")).drop("_own")
