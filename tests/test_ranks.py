"""Distributed positions equal a plain sort."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.functions.turns import seeded_hash
from pairwright.operators.joins import salted_join
from pairwright.operators.ranks import global_rank, hash_digits, ordered_rank, rank_within, running_before
from pairwright.operators.skew import HOT_KEYS, hot_keys, key_counts


def skewed(spark, rows=3000):
    """Key 0 holds a third of the rows, the rest are spread over 40 keys."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).cast("int")
    return spark.range(rows).select(F.col("id").alias("row_id"), key.alias("key")).repartition(7)


def test_global_rank(spark):
    found = {r.row_id: r["rank"] for r in global_rank(skewed(spark), 5, "row_id").collect()}
    ordered = sorted(range(3000), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    assert found == {row: place for place, row in enumerate(ordered)}


def test_buckets_follow_the_row_count():
    assert [hash_digits(n, 10) for n in (0, 2560, 2561, 40_960, 40_961)] == [2, 2, 3, 3, 4]
    assert hash_digits(10**11) == 5


def test_global_rank_over_two_levels(spark):
    """Five digits: no bucket has more than a few rows, and no window more than 4,096 counts."""
    ranked = global_rank(skewed(spark), 5, "row_id", bucket_rows=0.01)
    found = {r.row_id: r["rank"] for r in ranked.collect()}
    ordered = sorted(range(3000), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    assert found == {row: place for place, row in enumerate(ordered)}
    assert {r.n_rows for r in ranked.select("n_rows").distinct().collect()} == {3000}
    assert "_top#" in ranked._jdf.queryExecution().executedPlan().toString()


def test_another_seed_gives_another_order(spark):
    one, two = (
        [r.row_id for r in global_rank(spark.range(50).withColumnRenamed("id", "row_id"), seed,
                                       "row_id").orderBy("rank").collect()]
        for seed in (1, 2)
    )
    assert sorted(one) == sorted(two) and one != two


@pytest.mark.parametrize("digits", [0, 1, 2, 5])
def test_rank_within_equals_a_window(spark, digits):
    rows = skewed(spark).withColumn("h", seeded_hash(3, F.col("row_id")))
    ranked = rank_within(rows, ["key"], ["h", "row_id"], F.substring("h", 1, digits), digits=digits)
    group = Window.partitionBy("key")
    plain = rows.select(
        "row_id",
        "key",
        F.row_number().over(group.orderBy("h", "row_id")).alias("rank"),
        F.count("*").over(group).alias("group_size"),
    )
    columns = ["row_id", "key", "rank", "group_size"]
    assert ranked.select(*columns).exceptAll(plain.select(*columns)).count() == 0
    assert ranked.count() == 3000


def test_running_sums_equal_a_window(spark):
    rows = skewed(spark).withColumn("v", F.col("row_id") % 11)
    plain = rows.select(
        "row_id",
        F.coalesce(
            F.sum("v").over(Window.partitionBy(F.lit(0)).orderBy("key", "row_id").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("before"),
    )
    ours = running_before(rows, ["key", "row_id"], "v", "before").select("row_id", "before")
    assert ours.exceptAll(plain).count() == 0 and ours.count() == 3000


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_ordered_rank_equals_a_window(spark, keys):
    rows = skewed(spark).withColumn("ts", F.floor(F.col("row_id") / 500))
    ranked = ordered_rank(rows, keys, ["ts", "row_id"])
    plain = rows.select(
        "row_id",
        F.row_number().over(
            Window.partitionBy(*(keys or [F.lit(0)])).orderBy("ts", "row_id")
        ).cast("long").alias("rank"),
    )
    assert ranked.select("row_id", "rank").exceptAll(plain).count() == 0
    assert ranked.count() == 3000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [7, 1_000_000])
def test_salted_join_equals_a_plain_join(spark, how, hot_rows):
    left = skewed(spark)
    right = spark.range(0, 30).select(F.col("id").cast("int").alias("key"), (F.col("id") * 2).alias("v"))
    ours = salted_join(left, right, "key", how, ["row_id"], hot_rows=hot_rows)
    plain = left.join(right, "key", how)
    assert sorted(ours.columns) == sorted(plain.columns)
    ours = ours.select(*plain.columns)
    assert ours.count() == plain.count()
    assert ours.exceptAll(plain).count() == 0


def test_hot_list_is_bounded(spark):
    many = spark.range(4 * HOT_KEYS).select((F.col("id") % (2 * HOT_KEYS)).alias("key"))
    assert hot_keys(key_counts(many, ["key"]), ["key"], hot_rows=1).count() == HOT_KEYS
