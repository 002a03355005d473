"""Row positions without a single-task sort.

The rows are cut into buckets that follow the order, counted per bucket, and
numbered inside their bucket; the counts of the buckets before give the offset.
Buckets of a hash have as many hex digits as it takes to hold BUCKET_ROWS rows
each, and their offsets are summed level by level: over leading digits first,
then among the buckets that share these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.turns import seeded_hash
from pairwright.staging import stage

_PARTITION_BITS = 33  # monotonically_increasing_id: partition above, row position below
# Rows that a task numbers together, about.
BUCKET_ROWS = 100_000
# Hex digits whose buckets meet in one window: 4,096 rows of counts.
LEVEL_DIGITS = 3


def hash_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Leading hex digits of a hash that cut so many rows into buckets of about `bucket_rows`; two at least."""
    digits = 2
    while rows > bucket_rows * 16**digits:
        digits += 1
    return digits


def _offsets(counts: DataFrame, keys: Sequence[str], slot: str, digits: int = 0) -> DataFrame:
    """Replace the counts `_n` by `_before`, the rows of the keys' earlier slots.

    Slots of more than LEVEL_DIGITS `digits` are summed by their leading ones first, so no window meets more
    than 16 ** LEVEL_DIGITS rows of one key.
    """
    if digits > LEVEL_DIGITS:
        top = F.substring(slot, 1, digits - LEVEL_DIGITS)
        levelled = counts.withColumn("_top", top)
        above = levelled.groupBy(*keys, "_top").agg(F.sum("_n").alias("_n"))
        tops = _offsets(above, keys, "_top", digits - LEVEL_DIGITS).withColumnRenamed("_before", "_above")
        inside = _offsets(levelled, [*keys, "_top"], slot)
        met = inside.join(tops, [*keys, "_top"])
        return met.withColumn("_before", F.col("_above") + F.col("_before")).drop("_top", "_above")
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(slot)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return counts.withColumn("_before", running).drop("_n")


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    rank: str = "rank",
    size: str = "group_size",
    digits: int = 0,
) -> DataFrame:
    """1-based position of each row among the rows of its keys, and their number.

    Every group is cut by `bucket` and numbered by as many tasks as that has values:
    `bucket` must not fall as `order` rises, and its values must be few (leading
    digits of a hash; give their number as `digits` if it hangs on the data). Keys must not be null.
    """
    slotted = df.withColumn("_slot", bucket)
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    counts = slotted.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    # As many rows per keys as `bucket` has values, or as LEVEL_DIGITS digits have.
    if digits > LEVEL_DIGITS:
        whole = counts.join(counts.groupBy(*keys).agg(F.sum("_n").alias(size)), [*keys])
    else:
        whole = counts.withColumn(size, F.sum("_n").over(Window.partitionBy(*keys)))
    return (
        slotted.withColumn("_inside", F.row_number().over(inside))
        .join(_offsets(whole, keys, "_slot", digits), [*keys, "_slot"])
        .withColumn(rank, F.col("_before") + F.col("_inside"))
        .drop("_slot", "_inside", "_before")
    )


def running_before(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before each one, in ascending order.

    Rows are sorted by range; what the ranges before hold is a number per range. `order` must be unique per
    row. The sorted rows are staged, because sampled range bounds would differ between two evaluations.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    staged = stage(placed, "running").withColumn("_slot", F.shiftright("_place", _PARTITION_BITS))
    sums = staged.groupBy("_slot").agg(F.sum(value).alias("_n"))
    inside = Window.partitionBy("_slot").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(_offsets(sums, [], "_slot"), "_slot")
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_place", "_slot", "_before")
    )


def global_rank(
    df: DataFrame,
    seed: int,
    row_id: str,
    rank: str = "rank",
    size: str = "n_rows",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """0-based position of each row in the seeded permutation of all rows.

    Equals row_number() over (order by md5(seed:row_id), row_id) - 1. The rows are counted first, so hand in a
    written table; buckets hold about `bucket_rows` of them at any size.
    """
    rows = df.count()
    digits = hash_digits(rows, bucket_rows)
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(row_id)))
    slotted = hashed.withColumn("_slot", F.substring("_hash", 1, digits))
    counts = slotted.groupBy("_slot").agg(F.count("*").alias("_n"))
    offsets = _offsets(counts, [], "_slot", digits)
    if digits <= LEVEL_DIGITS:
        # Bounded by 16 ** LEVEL_DIGITS rows of two numbers; more of them meet the rows by their bucket.
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("_slot").orderBy("_hash", row_id)
    numbered = slotted.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, "_slot")
        .withColumns({rank: F.col("_before") + F.col("_inside") - 1, size: F.lit(rows).cast("long")})
        .drop("_hash", "_slot", "_inside", "_before")
    )


def ordered_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rank: str = "rank",
) -> DataFrame:
    """1-based position of each row among the rows of its keys, in value order.

    For orders that have no even hash digits to cut by, such as time stamps.
    Range partitions on (keys, order) split a big key by themselves. (keys,
    order) must be unique per row. The sorted rows are staged, because sampled
    range bounds would differ between two evaluations.
    """
    columns = [*keys, *order]
    placed = (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    staged = stage(placed, "ordered").withColumn(
        "_slot", F.shiftright("_place", _PARTITION_BITS)
    )
    counts = staged.groupBy(*keys, "_slot").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first")
    )
    # Per keys, or over all, one row for each range partition that holds some.
    spans = _offsets(counts, keys, "_slot")
    return (
        staged.join(spans, [*keys, "_slot"])
        .withColumn(rank, F.col("_before") + F.col("_place") - F.col("_first") + 1)
        .drop("_place", "_slot", "_first", "_before")
    )
