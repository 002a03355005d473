"""Folds keep prompts whole and classes even, also around a giant prompt."""

import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators.folds import (
    _least_deviation,
    assign_folds,
    filter_rows,
    fold_sizes,
    group_folds,
    training_rows,
    validation_rows,
)
from pairwright.schemas import LABEL_COLUMNS


def pairs(spark, rows=3000, giant=0):
    """Rows 0 … giant-1 share one prompt; the others have one to three rows per prompt."""
    row = F.col("id")
    prompt = F.when(row < giant, F.lit("giant")).otherwise(
        F.concat(F.lit("p"), F.when(row % 2 == 0, row % 700).otherwise(row))
    )
    label = F.pmod(F.xxhash64(row), F.lit(3))
    return spark.range(rows).select(
        row.cast("string").alias("id"),
        F.encode(prompt, "utf-8").alias("prompt_key"),
        *[(label == i).cast("double").alias(name) for i, name in enumerate(LABEL_COLUMNS)],
    )


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_prompts_stay_whole_and_folds_even(spark, hot_rows):
    table = pairs(spark)
    folded = assign_folds(table, 5, 0, hot_rows)
    assert folded.count() == 3000
    split = folded.groupBy("prompt_key").agg(F.count_distinct("fold").alias("n"))
    assert split.where("n > 1").count() == 0
    sizes = fold_sizes(folded).collect()
    assert [r.fold for r in sorted(sizes)] == list(range(5))
    for name in ("n_rows", "n_a", "n_b", "n_tie"):
        values = [r[name] for r in sizes]
        assert max(values) - min(values) <= 0.1 * sum(values) / 5 + 10


def test_a_giant_prompt_is_made_up_for(spark):
    table = pairs(spark, giant=500)
    sizes = fold_sizes(assign_folds(table, 5, 0)).collect()
    values = sorted(r.n_rows for r in sizes)
    # The giant fits into an even share of 600, so one-row prompts can even it out.
    assert values[-1] - values[0] <= 30


def test_a_prompt_beyond_an_even_share_leaves_the_other_folds_even(spark):
    sizes = fold_sizes(assign_folds(pairs(spark, giant=1000), 5, 0)).collect()
    values = sorted(r.n_rows for r in sizes)
    assert values[3] - values[0] <= 30
    assert values[4] <= 1250


def test_folds_do_not_depend_on_spreading(spark):
    table = pairs(spark, giant=1000)
    one = {r.id: r.fold for r in assign_folds(table, 5, 0, hot_rows=20).collect()}
    two = {r.id: r.fold for r in assign_folds(table, 5, 0).collect()}
    assert one == two and len(one) == 3000


def test_fewer_prompts_than_folds(spark):
    assert assign_folds(pairs(spark, rows=3), 5, 0).count() == 3


def of_sizes(spark, prompts=2000):
    """Prompts of 2 to 34 rows whose class depends on their size, as groups."""
    size = F.col("id") % 33 + 2
    n_a = F.floor(size * (F.col("id") % 33) / 32)
    n_b = F.floor((size - n_a) / 2)
    return spark.range(prompts).select(
        F.encode(F.col("id").cast("string"), "utf-8").alias("prompt_key"),
        n_a.alias("n_a"), n_b.alias("n_b"), (size - n_a - n_b).alias("n_tie"), size.alias("n_rows"),
    )


@pytest.mark.parametrize("big", [0, 50, 4096])
def test_classes_that_depend_on_the_size_are_even(spark, big):
    """One by one, in turn, or both: folds have the size mix and the class shares of the whole."""
    groups = of_sizes(spark)
    dealt = group_folds(groups, 5, 0, big)
    folds = dealt.groupBy("fold").agg(
        *[F.sum(n).alias(n) for n in ("n_a", "n_b", "n_tie", "n_rows")], F.count("*").alias("n")
    ).collect()
    whole = groups.agg(*[F.sum(n).alias(n) for n in ("n_a", "n_b", "n_tie", "n_rows")]).first()
    assert len(folds) == 5 and sum(f.n for f in folds) == 2000
    for fold in folds:
        assert abs(fold.n_rows / whole.n_rows - 0.2) < 0.002 and abs(fold.n - 400) <= 20
        for name in ("n_a", "n_b", "n_tie"):
            assert abs(fold[name] / fold.n_rows - whole[name] / whole.n_rows) < 0.005


def test_dealing_by_least_deviation():
    """Every vector went where the sum of squares is least."""
    rng = random.Random(2)
    vectors = [[rng.randint(0, 5) for _ in range(3)] for _ in range(200)]
    vectors = [[*v, sum(v)] for v in vectors]
    loads = [[0] * 4 for _ in range(4)]
    for vector, fold in zip(vectors, _least_deviation(vectors, 4)):
        def squares(f):
            return sum((x + y * (g == f)) ** 2 for g, load in enumerate(loads) for x, y in zip(load, vector))

        assert squares(fold) == min(squares(f) for f in range(4))
        loads[fold] = [x + y for x, y in zip(loads[fold], vector)]


def test_text_predicates(spark):
    table = spark.range(20).select((F.col("id") % 5).cast("int").alias("fold"))
    assert filter_rows(table, "fold != 0").count() == 16
    assert filter_rows(table, "fold == 0 or fold == 1").count() == 8
    assert filter_rows(table, None).count() == 20
    assert training_rows(table, 2).count() + validation_rows(table, 2).count() == 20
