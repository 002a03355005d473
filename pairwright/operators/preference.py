"""Chosen/rejected corpora to pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.turns import seeded_hash, texts_of
from pairwright.operators.quarantine import Split, split_checked

# Fixed value: id and model of a converted row.
UNKNOWN = "a"


def check_corpus(corpus: DataFrame) -> DataFrame:
    """Add `reason`: a rejected side shorter than the chosen one cannot be read turn by turn."""
    short = F.size("rejected") < F.size("chosen")
    missing = F.col("chosen").isNull() | F.col("rejected").isNull()
    return corpus.withColumn(
        "reason", F.when(missing, "missing_side").when(short, "short_rejected")
    )


def split_corpus(corpus: DataFrame) -> DataFrame:
    """(row_id, prompt, preferred, other). The first row that `check_corpus` finds unfit ends the job.

    `convert_corpus` sets such rows apart beforehand.
    """
    checked = check_corpus(corpus)
    stop = F.raise_error(F.concat(F.lit("unfit corpus row: "), F.col("reason")))
    chosen = F.when(F.col("reason").isNotNull(), stop.cast(corpus.schema["chosen"].dataType)).otherwise(F.col("chosen"))
    sound = checked.withColumn("chosen", chosen)
    chosen = F.col("chosen")
    # The rejected side is read only as far as the chosen one goes.
    rejected = F.slice("rejected", F.lit(1), F.size(chosen))
    return sound.select(
        *[c for c in corpus.columns if c not in ("chosen", "rejected")],
        texts_of(chosen, "user").alias("prompt"),
        texts_of(chosen, "assistant").alias("preferred"),
        texts_of(rejected, "assistant").alias("other"),
    )


def assign_sides(df: DataFrame, seed: int) -> DataFrame:
    """Put the preferred answer at A or B by one bit of the row's own hash."""
    at_a = F.substring(seeded_hash(seed, F.col("row_id")), 1, 1) < "8"
    return df.select(
        *[c for c in df.columns if c not in ("preferred", "other")],
        F.when(at_a, F.col("preferred")).otherwise(F.col("other")).alias("response_a"),
        F.when(at_a, F.col("other")).otherwise(F.col("preferred")).alias("response_b"),
        F.when(at_a, 1.0).otherwise(0.0).alias("winner_model_a"),
        F.when(at_a, 0.0).otherwise(1.0).alias("winner_model_b"),
        F.lit(0.0).alias("winner_tie"),
    )


def corpus_to_pairs(corpus: DataFrame, seed: int = 42) -> DataFrame:
    """Preference rows as pair rows; models are unknown, ties do not occur."""
    sided = assign_sides(split_corpus(corpus), seed)
    return sided.withColumns(
        {"id": F.lit(UNKNOWN), "model_a": F.lit(UNKNOWN), "model_b": F.lit(UNKNOWN)}
    )


def convert_corpus(corpus: DataFrame, seed: int = 42) -> tuple[DataFrame, Split]:
    """Pairs of the fit rows, and both sides of the check with their counts; no row gets lost between them."""
    split = split_checked(check_corpus(corpus), "corpus")
    return corpus_to_pairs(split.fit, seed), split


def with_placeholder_labels(pairs: DataFrame) -> DataFrame:
    """Labels 1/0/0 for pairs nobody has judged yet."""
    return pairs.withColumns(
        {"winner_model_a": F.lit(1.0), "winner_model_b": F.lit(0.0), "winner_tie": F.lit(0.0)}
    )
