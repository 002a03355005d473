"""Registered queries: operators over the driver's whole tables.

Results hold plain columns only. Lists are shown as JSON text, floats are
rounded to six places, so that another engine can be held against them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import views
from pairwright.functions.labels import label_index, label_vector, row_log_loss
from pairwright.functions.templates import JOINT, LOCALIZED, SPLIT, Template, judge_text, render
from pairwright.functions.text import token_count, truncate_tokens
from pairwright.functions.turns import decode_turns, encode_turns, key_text
from pairwright.operators.augment import (
    fan_out,
    flatten_samples,
    swap_augment,
    with_sample_lengths,
    with_turn_counts,
)
from pairwright.operators.chats import check_turns, split_chats, split_roles
from pairwright.operators.ensemble import (
    LOGIT_COLUMNS,
    attach_predictions,
    concat_sources,
    ensemble_mean,
    softmax_probs,
)
from pairwright.operators.folds import fold_sizes, training_rows, validation_rows
from pairwright.operators.losses import log_loss, micro_batch_loss, rolling_loss, weighted_loss
from pairwright.operators.mining import (
    attach_prompt_counts,
    candidate_keys,
    dedup_first,
    exclude_prompts,
    prompt_overlap,
    repeated_prompts,
)
from pairwright.operators.preference import check_corpus, convert_corpus
from pairwright.operators.preference import corpus_to_pairs as convert
from pairwright.operators.packing import (
    assign_shards,
    batch_totals,
    collate_varlen,
    order_in_batch,
    ordered_batches,
    pad_to_shards,
    plan_batches,
    position_ids,
    restore_order,
    seeded_batches,
)
from pairwright.operators.fitting import FitSettings, fit_preference, gradient_norms, predict_preference
from pairwright.operators.ranks import global_rank, ordered_rank
from pairwright.operators.scoring import score, score_micro_batches, tokenize_with, tokens_of
from pairwright.plans.labelling import LENGTH_INPUTS, pseudo_label, with_lengths
from pairwright.plans.recipes import (
    CORPORA_SOFT,
    EXTRA,
    MINED,
    MINED_SOFT,
    RECIPES,
    SHARDS as RECIPE_SHARDS,
    TRAINVAL,
    Recipe,
    recipe_batches,
    recipe_leaks,
    recipe_lengths,
    recipe_micro_batches,
    recipe_rows,
    recipe_samples,
)
from pairwright.schemas import LABEL_COLUMNS, PROBABILITY_COLUMNS
from pairwright.sources.corpora import CORPUS_NAMES, read_corpus, write_corpus
from pairwright.sources.pairs import read_pairs, write_pairs
from pairwright.sources.predictions import read_preds, write_preds
from pairwright.staging import stage, stage_path

TRUNCATE_TO = 100
SHUFFLE_SEED = 7
BATCH_SIZE = 15
SHARDS = 8
BUDGET = 2_048
MAX_LENGTH = 2_048
EVAL_BATCH_SIZE = 50
EVAL_SHARDS = 4
LOSS_WINDOW = 20
LOSS_EVERY = 10
SCORERS = ("s0", "s1", "s2")

Query = Callable[[SparkSession, str], DataFrame]


def rounded(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def as_json(name: str) -> Column:
    return encode_turns(F.col(name)).alias(name)


# Chats and corpora


def roles_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_roles(views.chats(spark, sf_dir))
    return split.select("conv_id", as_json("prompt"), as_json("response"))


def chat_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_turns(views.table(spark, sf_dir, "conversations"))
    return checked.withColumn("reason", F.coalesce("reason", F.lit("ok")))


def corpus_to_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.corpus_pairs(spark, sf_dir)
    # Out to text and back: the lists must survive it.
    lists = {c: encode_turns(decode_turns(encode_turns(F.col(c)))) for c in views.PAIR_TEXTS}
    return pairs.withColumns(lists)


# Mining


def prompt_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = attach_prompt_counts(candidate_keys(views.candidates(spark, sf_dir)))
    return repeated_prompts(counted).select(
        "row_id",
        *[key_text(F.col(name)).alias(name) for name in ("prompt_key", "response_key")],
        "n_pid",
    )


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_first(views.candidates(spark, sf_dir).drop("lang"))
    return kept.select("row_id", "model", as_json("prompt"), as_json("response"))


def pair_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.judged_pairs(spark, sf_dir).select(
        "id",
        "model_a",
        "model_b",
        as_json("prompt"),
        as_json("response_a"),
        as_json("response_b"),
        *LABEL_COLUMNS,
    )


def exclude_known_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = exclude_prompts(views.judged_plan(spark, sf_dir), views.known_prompts(spark, sf_dir))
    return left.select("id", "row_a", "row_b", "model_a", "model_b")


def prompts_in_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = prompt_overlap(views.judged_plan(spark, sf_dir), views.known_prompts(spark, sf_dir))
    return both.select(key_text(F.col("prompt_key")).alias("prompt_key"))


# Labels and folds


def label_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = label_vector()
    return views.judged_plan(spark, sf_dir).select(
        "id",
        label_index().alias("label"),
        *[vector[i].alias(f"label_{i}") for i in range(3)],
    )


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.folded_plan(spark, sf_dir).select("id", "fold")


def fold_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_sizes(views.folded_plan(spark, sf_dir))


def fold_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What folds must be, whatever the rule: every prompt whole, rows, classes and prompts of several rows even.

    A count may be off an even share by the most that one prompt brings of it, or by one.
    """
    folded = stage(views.folded_plan(spark, sf_dir), "folded")
    label = label_index()
    prompts = folded.groupBy("prompt_key").agg(
        F.count("*").alias("rows"),
        *[F.count_if(label == i).alias(name) for i, name in enumerate(LABEL_COLUMNS)],
        F.max("fold").alias("fold"),
        (F.count_distinct("fold") == 1).alias("whole"),
    ).withColumn("several", (F.col("rows") > 1).cast("long"))
    counted = ("rows", *LABEL_COLUMNS, "several")
    items = F.array(*[F.struct(F.lit(name).alias("what"), F.col(name).alias("n")) for name in counted])
    long = prompts.select("fold", "whole", F.inline(items))
    per_fold = long.groupBy("what", "fold").agg(F.sum("n").alias("n"))
    whole = long.groupBy("what").agg(
        F.sum("n").alias("total"), F.max("n").alias("most"), F.min("whole").alias("all_whole")
    )
    even = F.abs(F.col("n") - F.col("total") / views.FOLDS) <= F.greatest(F.lit(1), F.col("most"))
    return per_fold.join(whole, "what").select("fold", "what", "total", "most", (even & F.col("all_whole")).alias("met"))


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written by fold, so that each side opens its own folders only.
    folded = stage(
        views.folded_plan(spark, sf_dir).select("id", "fold"), "folded", partition_by=("fold",)
    )
    train = training_rows(folded, 0).withColumn("side", F.lit("train"))
    return train.unionAll(validation_rows(folded, 0).withColumn("side", F.lit("valid")))


# Variants and texts


def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = swap_augment(views.judged_pairs(spark, sf_dir))
    return doubled.select(
        "id",
        "swapped",
        "model_a",
        "model_b",
        as_json("prompt"),
        as_json("response_a"),
        as_json("response_b"),
        *LABEL_COLUMNS,
    )


def template_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = swap_augment(views.judged_plan(spark, sf_dir))
    return fan_out(doubled, [JOINT.name, SPLIT.name]).select(
        "id", "swapped", "template", "variant_no", "model_a", "model_b"
    )


def _sides() -> list[Column]:
    return [F.col(c) for c in views.PAIR_TEXTS]


def rendered(template: Template) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = render(template, *_sides(), max_length=MAX_LENGTH)
        return views.all_pairs(spark, sf_dir).select("row_id", text.alias("text"))

    return query


def null_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose length is a multiple of three are missing."""
    holed = [
        F.transform(side, lambda turn: F.when(F.length(turn) % 3 != 0, turn)) for side in _sides()
    ]
    return views.all_pairs(spark, sf_dir).select(
        "row_id",
        render(JOINT, *holed, max_length=MAX_LENGTH).alias("joint"),
        render(SPLIT, *holed).alias("split"),
    )


def judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.all_pairs(spark, sf_dir).select(
        "row_id",
        judge_text(JOINT, *_sides(), system_role=True).alias("with_system"),
        judge_text(SPLIT, *_sides(), system_role=False).alias("without_system"),
    )


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", truncate_tokens(F.col("text"), TRUNCATE_TO).alias("text")
    )


def token_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", token_count(F.col("text")).alias("n_tokens")
    )


def custom_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer of the user's: pieces of up to four characters of a word."""

    def tokenizer(texts: pd.Series) -> tuple[pd.Series, pd.Series]:
        pieces = texts.str.findall(r"[ \t\n\r]*[^ \t\n\r]{1,4}")
        return pieces.map(lambda one: "".join(one[:TRUNCATE_TO])), pieces.map(len)

    made = tokenize_with(tokenizer)(F.col("text"))
    return (
        views.table(spark, sf_dir, "documents")
        .select("doc_id", made.alias("made"))
        .select("doc_id", "made.*")
    )


# Order and batches


def shuffle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select("doc_id")
    return global_rank(documents, SHUFFLE_SEED, "doc_id").select("doc_id", "rank")


def _measured(spark: SparkSession, sf_dir: str, templates: list[Template], swap: bool) -> DataFrame:
    pairs = views.judged_pairs(spark, sf_dir).withColumnRenamed("id", "row_id")
    # A few numbers per pair, written before the ranking reads them twice.
    return stage(with_sample_lengths(pairs, templates, swap, MAX_LENGTH), "measured")


def _training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _measured(spark, sf_dir, [JOINT, SPLIT], swap=True)
    return flatten_samples(seeded_batches(measured, BATCH_SIZE, SHUFFLE_SEED))


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = order_in_batch(_training_samples(spark, sf_dir))
    placed = assign_shards(pad_to_shards(samples, SHARDS), SHARDS)
    return placed.select(
        "batch_id", "position", "row", "shard", "is_pad", "row_id", "variant_no", "seq_len"
    )


def eval_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _measured(spark, sf_dir, [JOINT], swap=False)
    samples = flatten_samples(ordered_batches(measured, EVAL_BATCH_SIZE))
    planned = plan_batches(samples, EVAL_SHARDS, BUDGET, by_length=False)
    return planned.select(
        "batch_id", "position", "row", "shard", "is_pad", "row_id", "seq_len", "micro_batch"
    )


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_batches(_training_samples(spark, sf_dir), SHARDS, BUDGET)


def token_budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select(
        "batch_id", "position", "row", "shard", "seq_len", "micro_batch"
    )


def varlen_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    collated = collate_varlen(_planned(spark, sf_dir))
    of_batch = Window.partitionBy("batch_id")
    return collated.select(
        "batch_id",
        "shard",
        "micro_batch",
        "batch_size",
        as_json("row_ids"),
        as_json("seq_lens"),
        as_json("cu_seqlens"),
        "max_seq_len",
        encode_turns(position_ids(F.col("seq_lens"))).alias("position_ids"),
        encode_turns(F.transform("labels", lambda one: one.cast("array<int>"))).alias("labels"),
        F.sum("batch_size").over(of_batch).alias("total_batch_size"),
    )


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_totals(collate_varlen(_planned(spark, sf_dir)))


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_order(_planned(spark, sf_dir), SHARDS).select(
        "batch_id", "position", "row_id", "variant_no"
    )


# Predictions and losses


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scorers' logits: each number of an embedding counts for one class of one scorer."""

    def logit(place: int) -> Column:
        own = F.filter("embedding", lambda value, at: at % 9 == place)
        return F.aggregate(own, F.lit(0.0), lambda total, value: total + value.cast("double"))

    scorers = F.array(
        *[
            F.struct(
                F.lit(scorer).alias("scorer"),
                *[
                    logit(3 * s + c).alias(name)
                    for c, name in enumerate(LOGIT_COLUMNS)
                ],
            )
            for s, scorer in enumerate(SCORERS)
        ]
    )
    return views.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.pmod("label", F.lit(3)).alias("true_class"),
        F.inline(scorers),
    )


def _true_labels() -> list[Column]:
    return [(F.col("true_class") == c).cast("double") for c in range(3)]


def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmax_probs(_logits(spark, sf_dir)).select(
        "row_id", "scorer", *[rounded(name) for name in PROBABILITY_COLUMNS]
    )


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ensemble_mean(softmax_probs(_logits(spark, sf_dir)), SCORERS)
    return means.select("row_id", *[rounded(name) for name in PROBABILITY_COLUMNS])


def eval_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = softmax_probs(_logits(spark, sf_dir))
    probabilities = [F.col(name) for name in PROBABILITY_COLUMNS]
    losses = log_loss(scored, _true_labels(), probabilities, by=["scorer"])
    return losses.select("scorer", "n", rounded("log_loss"))


def soft_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft labels: nine tenths on the true class, the rest spread evenly."""
    soft = [label * 0.85 + 0.05 for label in _true_labels()]
    batched = _logits(spark, sf_dir).withColumn("batch", F.floor(F.col("row_id") / 16))
    losses = micro_batch_loss(
        batched, soft, [F.col(name) for name in LOGIT_COLUMNS], by=["scorer", "batch"]
    )
    return weighted_loss(losses, by=["scorer"]).select("scorer", "n", rounded("loss"))


def attach_soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _logits(spark, sf_dir)
    means = ensemble_mean(softmax_probs(logits), SCORERS)
    pairs = views.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.pmod("label", F.lit(3)).alias("true_class"),
        *[F.lit(0.0).alias(name) for name in LABEL_COLUMNS],
    )
    return attach_predictions(pairs, means).select(
        "row_id", "true_class", *[rounded(name) for name in LABEL_COLUMNS]
    )


def smoothed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("loss")
    )
    steps = ordered_rank(events, ["run_id"], ["ts", "event_id"], rank="step")
    return rolling_loss(steps, LOSS_WINDOW, LOSS_EVERY).select(
        "run_id", "step", "loss", rounded("mean_loss")
    )


# Whole runs


def sources_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "lang", "n_chars"
    )
    english = documents.where(F.col("lang") == "en")
    others = documents.where(~F.col("lang").eqNullSafe("en"))
    return concat_sources(english, others)


def _recipe_counts(
    recipe: Recipe, side: str, tables: dict[str, DataFrame]
) -> DataFrame:
    samples = flatten_samples(recipe_lengths(recipe, side, tables))
    return (
        samples.groupBy("source_no", "swapped", "template")
        .agg(
            F.count("*").alias("n_samples"),
            F.sum("seq_len").alias("n_tokens"),
            F.round(F.sum(F.col("label")[0]), 6).alias("mass_a"),
        )
        .select(
            F.lit(recipe.name).alias("recipe"),
            F.lit(side).alias("side"),
            "source_no",
            "swapped",
            "template",
            "n_samples",
            "n_tokens",
            "mass_a",
        )
    )


def recipe_counts(names: tuple[str, ...], sides: tuple[str, ...], tables: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Turns are counted once for all recipes and sides.
        made = {
            name: stage(with_turn_counts(one), "counted")
            for name, one in views.recipe_tables(spark, sf_dir, *tables).items()
        }
        counts = [_recipe_counts(RECIPES[name], side, made) for name in names for side in sides]
        return reduce(DataFrame.unionByName, counts)

    return query


STAGE1 = ("stage1/m0", "stage1/m1", "stage1/m3")
PSEUDO = tuple(f"pseudo/{m}_{size}" for m in ("m0", "m1", "m3") for size in ("110k", "130k"))
STAGE2 = ("stage2/m0", "stage2/m3")
STAGE3 = ("stage3/m0", "stage3/m0val", "stage3/m3", "stage3/m3val")


# A stage-1 run, both sides, and the training side of a pseudo-label run.
RUNS = (("stage1/m0", "train"), ("stage1/m0", "valid"), ("pseudo/m3_110k", "train"))
PLAN_COLUMNS = (
    "batch_id", "position", "row", "shard", "is_pad", "row_id", "variant_no", "seq_len", "micro_batch"
)


def recipe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of three runs: its text's digest, its label and its length."""
    tables = views.recipe_tables(spark, sf_dir, TRAINVAL, EXTRA)
    parts = [
        recipe_samples(RECIPES[name], side, tables).select(
            F.lit(name).alias("recipe"),
            F.lit(side).alias("side"),
            "row_id",
            "variant_no",
            F.sha2("input_text", 256).alias("text_sha256"),
            encode_turns(F.col("label").cast("array<int>")).alias("label"),
            token_count(F.col("input_text")).alias("n_tokens"),
        )
        for name, side in RUNS
    ]
    return reduce(DataFrame.unionByName, parts)


def recipe_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batch plans of three runs."""
    tables = views.recipe_tables(spark, sf_dir, TRAINVAL, EXTRA)
    parts = [
        recipe_batches(RECIPES[name], side, tables).select(
            F.lit(name).alias("recipe"), F.lit(side).alias("side"), *PLAN_COLUMNS
        )
        for name, side in RUNS
    ]
    return reduce(DataFrame.unionByName, parts)


def _pieces(texts: pd.Series, limit: int | None) -> tuple[pd.Series, pd.Series]:
    """A tokenizer of the user's: pieces of up to four characters of a word."""
    found = texts.str.findall(r"[ \t\n\r]*[^ \t\n\r]{1,4}")
    cut = [
        text if limit is None or len(one) <= limit else "".join(one[:limit])
        for text, one in zip(texts, found)
    ]
    return pd.Series(cut), found.map(len)


def tokenizer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training plan of stage 1, with both templates and batches of 16 pairs, with a tokenizer of the user's."""
    tables = views.recipe_tables(spark, sf_dir, TRAINVAL, EXTRA)
    planned = recipe_batches(RECIPES["stage1/m3"], "train", tables, tokens=tokens_of(_pieces))
    return planned.select(*PLAN_COLUMNS)


# Both sides of a stage-1 run with small batches, the training side of another.
TEXT_RUNS = (("stage1/m0", "valid"), ("stage1/m3", "train"))


def batch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro batches of two runs with their texts, shown as digests."""
    tables = views.recipe_tables(spark, sf_dir, TRAINVAL, EXTRA)
    parts = []
    for name, side in TEXT_RUNS:
        made = recipe_micro_batches(RECIPES[name], side, tables)
        digests = F.transform("samples", lambda one: F.sha2(one["input_text"], 256))
        labels = F.transform("samples", lambda one: one["label"].cast("array<int>"))
        parts.append(
            made.select(
                F.lit(name).alias("recipe"),
                F.lit(side).alias("side"),
                "batch_id",
                "shard",
                "micro_batch",
                encode_turns(digests).alias("texts"),
                encode_turns(labels).alias("labels"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _digest_scorer(frame: pd.DataFrame) -> np.ndarray:
    """Logits from the digest of a text and its length: no other text has them."""
    digests = [hashlib.sha256(text.encode()).hexdigest() for text in frame["input_text"]]
    parts = [(int(one[:6], 16) / 2**24, int(one[6:12], 16) / 2**24) for one in digests]
    return np.column_stack([np.array(parts).reshape(-1, 2), frame["seq_len"].to_numpy() / 4096])


def planned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1's validation rows, scored by micro batches under the token budget and brought back in order."""
    tables = views.recipe_tables(spark, sf_dir, TRAINVAL, EXTRA)
    recipe = RECIPES["stage1/m0"]
    batches = stage(recipe_micro_batches(recipe, "valid", tables), "micro-batches")
    tokens = F.aggregate("samples", F.lit(0).cast("long"), lambda total, one: total + one["seq_len"])
    within = (tokens <= recipe.member.max_tokens) | (F.size("samples") == 1)
    budgets = batches.select("batch_id", "shard", "micro_batch", within.alias("within_budget"))
    logits = restore_order(score_micro_batches(batches, _digest_scorer), RECIPE_SHARDS)
    return logits.join(budgets, ["batch_id", "shard", "micro_batch"]).select(
        "row_id", "batch_id", F.col("position").cast("int").alias("position"), *[rounded(name) for name in LOGIT_COLUMNS], "within_budget"
    )


def recipe_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts both trained on and validated on, for the two kinds of last-stage recipe."""
    tables = views.recipe_tables(spark, sf_dir, TRAINVAL, EXTRA)
    found = [
        recipe_leaks(RECIPES[name], tables).withColumn("recipe", F.lit(name))
        for name in ("stage3/m0", "stage3/m0val")
    ]
    return reduce(DataFrame.unionByName, found).select(
        "recipe", key_text(F.col("prompt_key")).alias("prompt_key"), "n_train", "n_valid"
    )


def io_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, a corpus and predictions through every format; each must come back whole."""
    folded = stage(
        views.all_pairs(spark, sf_dir).withColumns(
            {"id": F.lit("a"), "fold": F.col("source_no")}
        ),
        "round_trip",
    )
    back = []
    for kind, multi_line in (("csv", True), ("csv", False), ("parquet", True)):
        path = stage_path(spark, f"pairs-{kind}")
        write_pairs(folded, path, kind)
        read = read_pairs(
            spark, path, kind, with_fold=True, multi_line=multi_line, with_row_id=True
        )
        lists = [as_json(c) for c in views.PAIR_TEXTS]
        label = F.lit(f"pairs-{kind}-{'whole' if multi_line else 'split'}").alias("route")
        back.append(read.select(label, F.col("row_id").alias("id"), "fold", *lists, *LABEL_COLUMNS))
    for kind in ("json", "parquet"):
        path = stage_path(spark, f"corpus-{kind}")
        write_corpus(views.corpus(spark, sf_dir), path, kind)
        corpus = read_corpus(spark, path, CORPUS_NAMES[0], kind, keyed=True)
        back.append(
            corpus.select(
                F.lit(f"corpus-{kind}").alias("route"),
                F.col("row_id").alias("id"),
                F.lit(-1).alias("fold"),
                F.to_json(F.transform("chosen", lambda turn: turn["content"])).alias("prompt"),
                F.to_json(F.transform("rejected", lambda turn: turn["content"])).alias(
                    "response_a"
                ),
                F.col("corpus").alias("response_b"),
                *[F.lit(0.0).alias(name) for name in LABEL_COLUMNS],
            )
        )
    path = stage_path(spark, "preds")
    write_preds(softmax_probs(_logits(spark, sf_dir)), path)
    back.append(
        read_preds(spark, path).select(
            F.lit("preds").alias("route"),
            F.col("row_id").alias("id"),
            F.lit(-1).alias("fold"),
            F.col("scorer").alias("prompt"),
            F.lit("").alias("response_a"),
            F.lit("").alias("response_b"),
            *[
                F.round(F.col(name), 6).alias(label)
                for name, label in zip(PROBABILITY_COLUMNS, LABEL_COLUMNS)
            ],
        )
    )
    return reduce(DataFrame.unionByName, back)


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus file without keys to pairs, to a file, to soft labels."""
    path, pairs_path = stage_path(spark, "raw-corpus"), stage_path(spark, "raw-pairs")
    write_corpus(views.corpus(spark, sf_dir), path, keyed=False)
    corpus = stage(read_corpus(spark, path, CORPUS_NAMES[0]), "keyed")
    write_pairs(convert(corpus.drop("corpus"), views.SEED), pairs_path, "csv")
    pairs = read_pairs(spark, pairs_path, "csv", multi_line=False, with_row_id=True)
    return views.soft_labels(pairs).select(
        "row_id",
        *[as_json(c) for c in views.PAIR_TEXTS],
        *[rounded(name) for name in LABEL_COLUMNS],
    )


def _broken_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus in which every fifth conversation has lost its last rejected turn."""
    corpus = views.corpus(spark, sf_dir)
    short = F.slice("rejected", F.lit(1), F.size("rejected") - 1)
    short_rows = F.pmod(F.col("row_id").cast("long"), F.lit(5)) == 0
    return corpus.withColumn("rejected", F.when(short_rows, short).otherwise(F.col("rejected")))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats and corpus rows that are used and those set apart, both with their texts, beside the counts of the pass."""
    pairs, corpus = convert_corpus(_broken_corpus(spark, sf_dir), views.SEED)
    chats = split_chats(views.chats(spark, sf_dir))
    content = F.transform(F.col("chosen"), lambda turn: turn["content"])
    turns = F.transform(F.col("conversation"), lambda turn: turn["content"])
    none = F.lit(None).cast("string")
    sides = [
        pairs.select(F.lit("corpus").alias("source"), "row_id", none.alias("reason"), as_json("prompt")),
        corpus.unfit.select(F.lit("corpus").alias("source"), "row_id", "reason", encode_turns(content).alias("prompt")),
        chats.fit.select(F.lit("chats").alias("source"), F.col("conv_id").cast("string").alias("row_id"), none.alias("reason"), as_json("prompt")),
        chats.unfit.select(F.lit("chats").alias("source"), F.col("conv_id").cast("string").alias("row_id"), "reason", encode_turns(turns).alias("prompt")),
    ]
    counts = {"corpus": corpus, "chats": chats}
    n_fit, n_unfit = (
        reduce(lambda rest, name: F.when(F.col("source") == name, getattr(counts[name], kind)).otherwise(rest), counts, F.lit(0))
        for kind in ("n_fit", "n_unfit")
    )
    return reduce(DataFrame.unionByName, sides).select(
        "source", "row_id", F.coalesce("reason", F.lit("ok")).alias("reason"), F.sha2("prompt", 256).alias("texts_sha256"),
        n_fit.cast("long").alias("n_fit"), n_unfit.cast("long").alias("n_unfit"),
    )


def corpus_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a corpus with its verdict."""
    checked = check_corpus(_broken_corpus(spark, sf_dir))
    return checked.select("row_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.judged_pairs(spark, sf_dir).withColumnRenamed("id", "row_id")
    measured = with_lengths(pairs).select("row_id", *LENGTH_INPUTS, *LABEL_COLUMNS)
    labelled = pseudo_label(stage(measured, "measured"), views.SCORERS, LENGTH_INPUTS)
    return labelled.select("row_id", *[rounded(name) for name in LABEL_COLUMNS])


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.judged_pairs(spark, sf_dir).withColumnRenamed("id", "row_id")
    measured = stage(with_lengths(pairs).select("row_id", *LENGTH_INPUTS), "measured")
    scored = score(measured, views.SCORERS, LENGTH_INPUTS)
    return scored.select("row_id", "scorer", *[rounded(name) for name in PROBABILITY_COLUMNS])


def fit_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on four folds, score the fifth.

    Of a fitted model SQL can know that every scored row has a probability mass of 1; that the mean
    probability of a class over the training rows is the class's share, as the intercepts are not
    penalised; and what loss the shares alone have, which the model must beat.
    """
    pairs = views.recipe_tables(spark, sf_dir, TRAINVAL)[TRAINVAL]
    training = stage(swap_augment(training_rows(pairs, 0)), "mirrored")
    model = fit_preference(training, FitSettings(steps=100))
    mass = reduce(Column.__add__, [F.col(name) for name in PROBABILITY_COLUMNS])
    scored = predict_preference(model, validation_rows(pairs, 0), "words").select(
        "row_id", F.lit("mass").alias("what"), F.round(mass, 6).alias("value"), F.lit(True).alias("met")
    )
    fitted = predict_preference(model, training.withColumn("row_id", F.struct("row_id", *LABEL_COLUMNS)), "words")
    labels = [F.col(f"row_id.{name}") for name in LABEL_COLUMNS]
    means = fitted.agg(
        *[F.avg(label).alias(f"share_{i}") for i, label in enumerate(labels)],
        *[F.avg(name).alias(f"mean_{i}") for i, name in enumerate(PROBABILITY_COLUMNS)],
        F.avg(row_log_loss(labels, [F.col(name) for name in PROBABILITY_COLUMNS])).alias("loss"),
    )
    shares = [F.col(f"share_{i}") for i in range(3)]
    prior = -reduce(Column.__add__, [F.when(s > 0, s * F.log(s)).otherwise(0.0) for s in shares])
    facts = F.array(
        *[
            F.struct(
                F.lit(name).alias("row_id"),
                F.lit("share").alias("what"),
                F.round(share, 6).alias("value"),
                (F.abs(F.col(f"mean_{i}") - share) < 0.01).alias("met"),
            )
            for i, (name, share) in enumerate(zip(LABEL_COLUMNS, shares))
        ],
        F.struct(
            F.lit("prior").alias("row_id"),
            F.lit("loss").alias("what"),
            F.round(prior, 6).alias("value"),
            (F.col("loss") < prior).alias("met"),
        ),
    )
    return scored.unionByName(means.select(F.inline(facts)))


SOFT_FIT = FitSettings(features=128, steps=100)


def fit_soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage-2 run: fit on the soft labels of all mined and converted pairs and their mirrors.

    What shows that the fit is the one asked for: along no part of the model does the penalised soft cross entropy
    slope; the mean probabilities are the mean labels; the loss is below that of the mean labels alone.
    """
    tables = views.recipe_tables(spark, sf_dir, MINED_SOFT, CORPORA_SOFT)
    rows = recipe_rows(RECIPES["stage2/m0"], "train", tables).drop("model_a", "model_b", "prompt")
    training = stage(swap_augment(rows), "soft")
    model = fit_preference(training, SOFT_FIT)
    slopes = gradient_norms(model, training).select(
        F.col("part").alias("what"), F.round("worst", 3).alias("value"), (F.col("worst") < 1e-3).alias("met")
    )
    key = F.struct("row_id", "swapped", *LABEL_COLUMNS)
    fitted = predict_preference(model, training.withColumn("row_id", key), "words")
    labels = [F.col(f"row_id.{name}") for name in LABEL_COLUMNS]
    means = fitted.agg(
        F.count("*").alias("n"),
        *[F.avg(label).alias(f"share_{i}") for i, label in enumerate(labels)],
        *[F.avg(name).alias(f"mean_{i}") for i, name in enumerate(PROBABILITY_COLUMNS)],
        F.avg(row_log_loss(labels, [F.col(name) for name in PROBABILITY_COLUMNS])).alias("loss"),
    )
    shares = [F.col(f"share_{i}") for i in range(3)]
    prior = -reduce(Column.__add__, [s * F.log(s) for s in shares])
    facts = [("rows", F.col("n").cast("double"), F.lit(True)), ("prior", F.round(prior, 6), F.col("loss") < prior)]
    facts += [
        (name, F.round(share, 6), F.abs(F.col(f"mean_{i}") - share) < 1e-3)
        for i, (name, share) in enumerate(zip(LABEL_COLUMNS, shares))
    ]
    listed = F.array(*[F.struct(F.lit(what).alias("what"), value.alias("value"), met.alias("met")) for what, value, met in facts])
    return slopes.unionByName(means.select(F.inline(listed)))


QUERIES: dict[str, Query] = {
    "roles_split": roles_split,
    "chat_validation": chat_validation,
    "corpus_to_pairs": corpus_to_pairs,
    "prompt_frequency": prompt_frequency,
    "dedup_first": dedup,
    "pair_mining": pair_mining,
    "exclude_known_prompts": exclude_known_prompts,
    "prompt_overlap": prompts_in_common,
    "label_argmax": label_argmax,
    "fold_assignment": fold_assignment,
    "fold_balance": fold_balance,
    "fold_shares": fold_shares,
    "holdout_split": holdout_split,
    "swap_augment": mirrored,
    "template_fan_out": template_fan_out,
    "render_joint": rendered(JOINT),
    "render_split": rendered(SPLIT),
    "render_localized": rendered(LOCALIZED),
    "render_null_turns": null_turns,
    "judge_prompt": judge_prompt,
    "truncate_text": truncate_text,
    "token_length": token_length,
    "custom_tokenizer": custom_tokenizer,
    "shuffle_rank": shuffle_rank,
    "batch_plan": batch_plan,
    "eval_batch_plan": eval_batch_plan,
    "token_budget_plan": token_budget_plan,
    "varlen_offsets": varlen_offsets,
    "batch_totals": batch_sizes,
    "restore_order": restored,
    "softmax_probs": softmax_rows,
    "ensemble_mean": ensemble,
    "eval_log_loss": eval_log_loss,
    "soft_cross_entropy": soft_cross_entropy,
    "attach_soft_labels": attach_soft_labels,
    "rolling_loss": smoothed_loss,
    "concat_sources": sources_in_order,
    "recipe_stage1": recipe_counts(STAGE1, ("train", "valid"), (TRAINVAL, EXTRA)),
    "recipe_pseudo": recipe_counts(PSEUDO, ("valid",), (MINED, *CORPUS_NAMES)),
    "recipe_stage2": recipe_counts(
        STAGE2, ("train", "valid"), (TRAINVAL, MINED_SOFT, CORPORA_SOFT)
    ),
    "recipe_stage3": recipe_counts(STAGE3, ("train", "valid"), (TRAINVAL, EXTRA)),
    "recipe_samples": recipe_texts,
    "recipe_batches": recipe_plans,
    "tokenizer_batches": tokenizer_plan,
    "micro_batch_texts": batch_texts,
    "planned_scores": planned_scores,
    "recipe_leak_check": recipe_leak_check,
    "io_round_trip": io_round_trip,
    "raw_corpus": raw_corpus,
    "corpus_check": corpus_check,
    "quarantine": quarantine,
    "score_rows": score_rows,
    "pseudo_label": pseudo_labels,
    "fit_and_score": fit_and_score,
    "fit_soft_labels": fit_soft_labels,
}
