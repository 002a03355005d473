"""Which tables, filters, variants and budgets go into each training run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.templates import JOINT, SPLIT, Template
from pairwright.functions.turns import seeded_hash, turns_key
from pairwright.functions.text import WHITESPACE, Tokens
from pairwright.operators.augment import (
    TURN_COUNTS,
    flatten_samples,
    sample_texts,
    variant_texts,
    with_sample_lengths,
)
from pairwright.operators.ensemble import concat_sources
from pairwright.operators.folds import filter_rows
from pairwright.operators.packing import micro_batch_texts, ordered_batches, plan_batches, seeded_batches
from pairwright.schemas import LABEL_COLUMNS, TURN_COLUMNS
from pairwright.sources.corpora import CORPUS_NAMES
from pairwright.staging import stage

# Table names a recipe may ask for.
TRAINVAL = "trainval"  # labelled pairs with a fold
EXTRA = "extra"  # more labelled pairs, no fold
MINED = "mined"  # unlabelled pairs
MINED_SOFT = "mined_soft"  # the same with ensemble labels
CORPORA_SOFT = "corpora_soft"  # all converted corpora with ensemble labels

# What a recipe reads of a table, next to the columns its predicate names.
ROW_COLUMNS = ("row_id", "model_a", "model_b", *TURN_COLUMNS, *LABEL_COLUMNS)

VALIDATION_FOLD = 0
SHARDS = 4


@dataclass(frozen=True)
class Source:
    table: str
    predicate: str | None = None


@dataclass(frozen=True)
class Member:
    """What a model of the ensemble asks for, whatever the stage."""

    max_length: int
    batch_size: int
    max_tokens: int
    system_role: bool
    log_every: int
    log_window: int


@dataclass(frozen=True)
class Recipe:
    name: str
    member: Member
    train: tuple[Source, ...]
    valid: tuple[Source, ...]
    train_templates: tuple[Template, ...]
    valid_templates: tuple[Template, ...] = (JOINT,)
    eval_batch_size: int = 80

    def sources(self, side: str) -> tuple[Source, ...]:
        return {"train": self.train, "valid": self.valid}[side]

    def templates(self, side: str) -> tuple[Template, ...]:
        return {"train": self.train_templates, "valid": self.valid_templates}[side]


# Budgets and logging of the ensemble members.
MEMBERS = {
    "m0": Member(4096, 80, 16_384, system_role=False, log_every=10, log_window=20),
    "m1": Member(4096, 80, 2_048, system_role=False, log_every=1, log_window=20),
    "m3": Member(2048, 16, 16_384, system_role=True, log_every=50, log_window=100),
}
# Fixed value: the last stage gives m0 bigger batches.
LAST_STAGE_M0 = Member(4096, 400, 16_384, system_role=False, log_every=2, log_window=4)


def _recipes() -> dict[str, Recipe]:
    outside = Source(TRAINVAL, f"fold != {VALIDATION_FOLD}")
    inside = (Source(TRAINVAL, f"fold == {VALIDATION_FOLD}"),)
    first_train = (outside, Source(EXTRA))
    both = (JOINT, SPLIT)
    corpora = tuple(Source(name) for name in CORPUS_NAMES)
    made: list[Recipe] = []
    for name, member in MEMBERS.items():
        templates = (JOINT,) if name == "m1" else both
        made.append(Recipe(f"stage1/{name}", member, first_train, inside, templates))
        # Pseudo labels: the first stage's run with other rows to score.
        made.append(
            Recipe(f"pseudo/{name}_110k", member, first_train, (Source(MINED),), templates)
        )
        made.append(Recipe(f"pseudo/{name}_130k", member, first_train, corpora, templates))
    for name in ("m0", "m3"):
        soft = (Source(MINED_SOFT), Source(CORPORA_SOFT))
        made.append(Recipe(f"stage2/{name}", MEMBERS[name], soft, inside, (JOINT,)))
        last = LAST_STAGE_M0 if name == "m0" else MEMBERS[name]
        # The last stage trains on every fold; its `val` variant holds one out.
        every = (Source(TRAINVAL), Source(EXTRA))
        made.append(Recipe(f"stage3/{name}", last, every, inside, (JOINT,)))
        made.append(Recipe(f"stage3/{name}val", last, first_train, inside, (JOINT,)))
    return {recipe.name: recipe for recipe in made}


RECIPES = _recipes()


def recipe_rows(recipe: Recipe, side: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The pairs of one side: filtered sources, one after the other."""
    used = [tables[source.table] for source in recipe.sources(side)]
    # Counts of the turns come along where every table has them.
    counts = TURN_COUNTS if all(set(TURN_COUNTS) <= set(one.columns) for one in used) else ()
    parts = [
        filter_rows(tables[source.table], source.predicate).select(*ROW_COLUMNS, *counts)
        for source in recipe.sources(side)
    ]
    return concat_sources(*parts)


def recipe_samples(
    recipe: Recipe, side: str, tables: Mapping[str, DataFrame], tokens: Tokens = WHITESPACE
) -> DataFrame:
    """Samples with their texts; mirrors in training only."""
    return sample_texts(
        recipe_rows(recipe, side, tables),
        recipe.templates(side),
        include_swap=side == "train",
        max_length=recipe.member.max_length,
        system_role=recipe.member.system_role,
        tokens=tokens,
    )


def recipe_lengths(
    recipe: Recipe, side: str, tables: Mapping[str, DataFrame], tokens: Tokens = WHITESPACE
) -> DataFrame:
    """Samples by their lengths and labels, one row per pair, without texts."""
    return with_sample_lengths(
        recipe_rows(recipe, side, tables),
        recipe.templates(side),
        include_swap=side == "train",
        max_length=recipe.member.max_length,
        system_role=recipe.member.system_role,
        keep=("source_no", "row_id"),
        tokens=tokens,
    )


def recipe_batches(
    recipe: Recipe,
    side: str,
    tables: Mapping[str, DataFrame],
    seed: int = 0,
    shards: int = SHARDS,
    tokens: Tokens = WHITESPACE,
) -> DataFrame:
    """Micro-batch plan of one side, without texts.

    The lengths are staged: a few numbers per row that the ranking reads twice,
    where a second run over the texts would cost far more.
    """
    training = side == "train"
    measured = stage(recipe_lengths(recipe, side, tables, tokens), "measured")
    if training:
        batched = seeded_batches(measured, recipe.member.batch_size, seed)
    else:
        batched = ordered_batches(
            measured, recipe.eval_batch_size, order=("source_no", "row_id")
        )
    return plan_batches(
        flatten_samples(batched), shards, recipe.member.max_tokens, by_length=training
    )


def recipe_micro_batches(
    recipe: Recipe,
    side: str,
    tables: Mapping[str, DataFrame],
    seed: int = 0,
    shards: int = SHARDS,
    tokens: Tokens = WHITESPACE,
) -> DataFrame:
    """The micro batches of one side with their texts: (batch_id, shard, micro_batch, samples)."""
    planned = stage(recipe_batches(recipe, side, tables, seed, shards, tokens), "plan")
    training = side == "train"
    row_id = F.col("row_id")
    # The order in which rows were put into batches.
    source = F.lpad(F.col("source_no").cast("string"), 10, "0")
    key = F.concat(seeded_hash(seed, row_id) if training else source, row_id)
    texts = variant_texts(
        recipe.templates(side),
        include_swap=training,
        max_length=recipe.member.max_length,
        system_role=recipe.member.system_role,
        tokens=tokens,
    )
    return micro_batch_texts(planned, recipe_rows(recipe, side, tables), key, texts)


def prompt_leaks(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Prompts on both sides, with their row counts. No row means no leak.

    Both sides are counted in one pass; nothing is joined, so a prompt that
    fills a third of the rows costs one counter per task.
    """
    sides = train.select("prompt_key", F.lit(1).alias("_train"), F.lit(0).alias("_valid")).unionAll(
        valid.select("prompt_key", F.lit(0).alias("_train"), F.lit(1).alias("_valid"))
    )
    return (
        sides.groupBy("prompt_key")
        .agg(F.sum("_train").alias("n_train"), F.sum("_valid").alias("n_valid"))
        .where((F.col("n_train") > 0) & (F.col("n_valid") > 0))
    )


def recipe_leaks(recipe: Recipe, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Prompts a recipe both trains on and validates on."""
    train, valid = (
        recipe_rows(recipe, side, tables).select(turns_key(F.col("prompt")).alias("prompt_key"))
        for side in ("train", "valid")
    )
    return prompt_leaks(train, valid)
