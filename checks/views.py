"""Pair data derived from the driver's tables.

No pair table is supplied. Documents that open with the same word act as
answers of different models (their source) to one prompt; conversations act as
a chat log and, with their answers spelled backwards as the rejected side, as a
preference corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.text import WORD
from pairwright.functions.turns import turns_key
from pairwright.operators.chats import nest_turns
from pairwright.operators.folds import assign_folds
from pairwright.operators.mining import candidate_keys, exclude_prompts, fetch_texts, pair_plan
from pairwright.operators.preference import corpus_to_pairs, with_placeholder_labels
from pairwright.plans.labelling import (
    LENGTH_INPUTS,
    length_scorer,
    pseudo_label,
    with_lengths,
)
from pairwright.plans.recipes import (
    CORPORA_SOFT,
    EXTRA,
    MINED,
    MINED_SOFT,
    TRAINVAL,
)
from pairwright.operators.ensemble import concat_sources
from pairwright.schemas import LABEL_COLUMNS
from pairwright.sources.corpora import CORPUS_NAMES
from pairwright.staging import stage

SEED = 42
FOLDS = 5
FOLD_SEED = 0
# Three corpora are one language each, the fourth takes every other one, or none.
LANGUAGES = ("de", "en", "es")
SCORERS = {
    "short_sighted": length_scorer(0.5, 0.1),
    "even_handed": length_scorer(1.0, 0.4),
    "blunt": length_scorer(2.0, -0.2),
}
PAIR_TEXTS = ("prompt", "response_a", "response_b")


# The driver's tables as they are, so that no footer is read for a schema.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
        " props string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def first_word(text: str) -> Column:
    return F.substring_index(text, " ", 1)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per document: (row_id, model, lang, prompt, response)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("model"),
        "lang",
        F.array(first_word("text")).alias("prompt"),
        F.array("text").alias("response"),
    )


def judged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate digests with the quality of their document, 0 where unlabelled."""
    quality = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality")
    )
    keys = candidate_keys(candidates(spark, sf_dir), carry=["lang"])
    return keys.join(quality, "row_id", "left").withColumn(
        "quality", F.coalesce("quality", F.lit(0))
    )


def judged_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined pairs without texts: the better document wins, else a tie."""
    plan = pair_plan(judged_keys(spark, sf_dir), SEED, carry=["quality", "lang"])
    a, b = F.col("quality_a"), F.col("quality_b")
    return plan.select(
        "id",
        "prompt_key",
        "row_a",
        "row_b",
        "model_a",
        "model_b",
        F.col("lang_a").alias("lang"),
        (a > b).cast("double").alias("winner_model_a"),
        (b > a).cast("double").alias("winner_model_b"),
        (a == b).cast("double").alias("winner_tie"),
    )


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined pairs with their texts."""
    return fetch_texts(judged_plan(spark, sf_dir), candidates(spark, sf_dir))


def folded_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_folds(stage(judged_plan(spark, sf_dir), "plan"), FOLDS, FOLD_SEED)


def known_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that are spoken for already: the words of the benchmark texts."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    named = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("word"))
    return named.select(turns_key(F.array("word")).alias("prompt_key"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested rows."""
    return nest_turns(table(spark, sf_dir, "conversations"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, chosen, rejected): rejected answers are the chosen ones backwards."""
    backwards = F.transform(
        "conversation",
        lambda turn: F.struct(
            turn["role"].alias("role"),
            F.when(turn["role"] == "assistant", F.reverse(turn["content"]))
            .otherwise(turn["content"])
            .alias("content"),
        ),
    )
    return chats(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("row_id"),
        F.col("conversation").alias("chosen"),
        backwards.alias("rejected"),
    )


def corpus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_to_pairs(corpus(spark, sf_dir), SEED)


def _as_source(pairs: DataFrame, row_id: str, *more: str) -> DataFrame:
    return pairs.select(
        F.col(row_id).alias("row_id"), "model_a", "model_b", *PAIR_TEXTS, *LABEL_COLUMNS, *more
    )


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined pairs (one turn) and corpus pairs (many turns, some of unequal length)."""
    return concat_sources(
        _as_source(judged_pairs(spark, sf_dir), "id"),
        _as_source(corpus_pairs(spark, sf_dir), "row_id"),
    )


def recipe_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The tables recipes read, each written once; only those asked for.

    The five corpora are the mined pairs of three languages, those of all others, and
    the converted conversations.
    """
    wanted = set(names)
    if CORPORA_SOFT in wanted:
        wanted.update(CORPUS_NAMES)
    if MINED_SOFT in wanted:
        wanted.add(MINED)
    made: dict[str, DataFrame] = {}
    if wanted & {TRAINVAL, MINED, *CORPUS_NAMES[:-1]}:
        pairs = stage(judged_pairs(spark, sf_dir), "judged")
    if TRAINVAL in wanted:
        folded = assign_folds(pairs, FOLDS, FOLD_SEED)
        made[TRAINVAL] = stage(
            _as_source(folded, "id", "fold"), "trainval", partition_by=("fold",)
        )
    if MINED in wanted:
        left = exclude_prompts(pairs, known_prompts(spark, sf_dir))
        made[MINED] = stage(_as_source(with_placeholder_labels(left), "id"), "mined")
    if wanted & {EXTRA, CORPUS_NAMES[-1]}:
        converted = stage(_as_source(corpus_pairs(spark, sf_dir), "row_id"), "converted")
        made[EXTRA] = converted
        made[CORPUS_NAMES[-1]] = converted
    if wanted & set(CORPUS_NAMES[:-1]):
        for name, lang in zip(CORPUS_NAMES, LANGUAGES):
            made[name] = _as_source(pairs.where(F.col("lang") == lang), "id")
        rest = ~F.coalesce(F.col("lang").isin(*LANGUAGES), F.lit(False))
        made[CORPUS_NAMES[len(LANGUAGES)]] = _as_source(pairs.where(rest), "id")
    if MINED_SOFT in wanted:
        made[MINED_SOFT] = stage(soft_labels(made[MINED]), "mined_soft")
    if CORPORA_SOFT in wanted:
        whole = concat_sources(*[made[name] for name in CORPUS_NAMES]).drop("source_no")
        made[CORPORA_SOFT] = stage(soft_labels(whole), "corpora_soft")
    return {name: made[name] for name in names}


def soft_labels(pairs: DataFrame) -> DataFrame:
    """Labels from the mean of three length scorers."""
    labelled = pseudo_label(with_lengths(pairs), SCORERS, LENGTH_INPUTS)
    return labelled.drop(*LENGTH_INPUTS)
