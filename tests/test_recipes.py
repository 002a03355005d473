"""Recipes: which rows and variants they bring, batches, leaks."""

import pytest
from pyspark.sql import functions as F

from checks import views
from pairwright.plans.recipes import (
    EXTRA,
    RECIPES,
    TRAINVAL,
    recipe_batches,
    recipe_leaks,
    recipe_rows,
    recipe_samples,
)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return views.recipe_tables(spark, sf_dir, TRAINVAL, EXTRA)


def test_there_are_fifteen_recipes():
    assert len(RECIPES) == 15
    assert {name.split("/")[0] for name in RECIPES} == {"stage1", "pseudo", "stage2", "stage3"}


def test_variants_per_row(tables):
    for name, per_row in (("stage1/m0", 4), ("stage1/m1", 2), ("stage3/m3", 2)):
        rows = recipe_rows(RECIPES[name], "train", tables).count()
        samples = recipe_samples(RECIPES[name], "train", tables)
        assert samples.count() == per_row * rows
        assert recipe_samples(RECIPES[name], "valid", tables).where("swapped").count() == 0


def test_full_training_leaks_and_the_val_variant_does_not(tables):
    own = {TRAINVAL: tables[TRAINVAL], EXTRA: tables[EXTRA]}
    held_out = own[TRAINVAL].where("fold = 0").select("prompt").distinct().count()
    assert recipe_leaks(RECIPES["stage3/m0"], own).count() == held_out > 0
    assert recipe_leaks(RECIPES["stage3/m0val"], own).count() == 0


def test_samples_and_batches_agree_on_lengths(tables):
    recipe = RECIPES["stage1/m3"]
    from pairwright.functions.text import token_count

    texts = recipe_samples(recipe, "valid", tables).select(
        "row_id", "template", token_count(F.col("input_text")).alias("seq_len")
    )
    planned = recipe_batches(recipe, "valid", tables).where("not is_pad")
    assert planned.count() == texts.count()
    both = planned.select("row_id", "template", "seq_len")
    assert both.exceptAll(texts).count() == 0


def test_training_batches_keep_the_budget(tables):
    recipe = RECIPES["stage1/m3"]
    planned = recipe_batches(recipe, "train", tables)
    assert planned.count() > 0
    spent = planned.groupBy("batch_id", "shard", "micro_batch").agg(
        F.sum("seq_len").alias("tokens"), F.count("*").alias("n")
    )
    assert spent.where(f"tokens > {recipe.member.max_tokens} and n > 1").count() == 0
