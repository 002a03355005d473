"""Filters in front of joins, and keys made from content."""

import pytest
from pyspark.sql import functions as F

from pairwright.operators.filters import LEAST_WORDS, MOST_WORDS, filter_words, may_be_among
from pairwright.operators.keys import with_row_key
from pairwright.staging import stage


def test_sizes_follow_the_keys():
    assert filter_words(0) == LEAST_WORDS and filter_words(10**12) == MOST_WORDS
    assert filter_words(512) == 128 and filter_words(513) == 256
    for keys in (10_000, 1_000_000):
        assert 16 * keys <= 64 * filter_words(keys) < 32 * keys


@pytest.mark.parametrize("keys", [0, 1, 1000, 60_000])
def test_no_key_is_missed_and_few_others_pass(spark, keys):
    held = stage(spark.range(keys).select((F.col("id") * 7).alias("k")), "keys")
    rows = spark.range(500_000).withColumnRenamed("id", "k")
    passed = rows.where(may_be_among(held, "k"))
    among = (F.col("k") % 7 == 0) & (F.col("k") < 7 * keys)
    found = passed.agg(F.count_if(among).alias("yes"), F.count_if(~among).alias("wrong")).first()
    assert found.yes == keys and found.wrong <= 0.04 * (500_000 - keys)


def test_null_and_text_keys(spark):
    held = spark.createDataFrame([("a",), (None,)], "k string")
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    among = rows.withColumn("among", may_be_among(held, "k")).collect()
    assert {r.n for r in among if r.among} >= {1, 2} and all(r.among is not None for r in among)


def test_contents_that_only_join_alike_have_keys_of_their_own(spark):
    rows = [("a\nb", "c"), ("a", "b\nc"), ("", None), (None, ""), ("1:x", ""), ("", "1:x")]
    keyed = with_row_key(spark.createDataFrame(rows, "x string, y string")).collect()
    assert len({r.row_id for r in keyed}) == 6 and all(r.row_id.endswith("-1") for r in keyed)
    assert {(r.x, r.y) for r in keyed} == set(rows)


def test_equal_rows_are_numbered(spark):
    """A row that fills a third of the table, one that is there twice, single ones; nested columns too."""
    rows = [([("user", "q")], 1)] * 400 + [([("user", None)], None)] * 2 + [([("user", str(i))], i) for i in range(800)]
    frame = spark.createDataFrame(rows, "chat array<struct<role: string, content: string>>, n int").repartition(5)
    keyed = with_row_key(frame)
    assert keyed.columns == ["row_id", "chat", "n"]
    found = keyed.collect()
    assert len(found) == len({r.row_id for r in found}) == 1202
    copies = sorted(int(r.row_id.split("-")[1]) for r in found if r.n == 1 and r.chat[0].content == "q")
    assert copies == list(range(1, 401))
    again = {r.row_id for r in with_row_key(frame.repartition(2)).collect()}
    assert again == {r.row_id for r in found}
    assert with_row_key(frame.where("false")).count() == 0
