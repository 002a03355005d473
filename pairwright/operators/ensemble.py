"""Predictions keyed by row: averaging scorers, replacing labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import softmax
from pairwright.functions.turns import present_key
from pairwright.schemas import LABEL_COLUMNS, PROBABILITY_COLUMNS

LOGIT_COLUMNS = ("logit_a", "logit_b", "logit_tie")


def softmax_probs(logits: DataFrame) -> DataFrame:
    """Logit columns to probability columns."""
    probabilities = softmax([F.col(name).cast("double") for name in LOGIT_COLUMNS])
    return logits.withColumns(dict(zip(PROBABILITY_COLUMNS, probabilities))).drop(*LOGIT_COLUMNS)


def ensemble_mean(predictions: DataFrame, scorers: Sequence[str]) -> DataFrame:
    """Mean over the named scorers per row and class.

    Ends the job when a row lacks one of them, has one twice, or has a stranger:
    a mean over the wrong members looks like any other mean.
    """
    stop = F.raise_error(
        F.concat(F.lit("row without just its scorers: "), F.col("row_id").cast("string"))
    ).cast("double")
    once = [f"_has_{number}" for number in range(len(scorers))]
    means = predictions.groupBy("row_id").agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("scorer") == s).alias(name) for s, name in zip(scorers, once)],
        *[F.avg(name).alias(name) for name in PROBABILITY_COLUMNS],
    )
    complete = reduce(and_, [F.col(name) == 1 for name in once], F.col("_n") == len(scorers))
    checked: dict[str, Column] = {
        name: F.when(complete, F.col(name)).otherwise(stop) for name in PROBABILITY_COLUMNS
    }
    return means.withColumns(checked).drop("_n", *once)


def attach_predictions(pairs: DataFrame, means: DataFrame) -> DataFrame:
    """Replace the labels of `pairs` by the probabilities of the same `row_id`.

    Both tables must hold the same rows: one that is missing on either side
    ends the job. Both sides have one row per id, so no key is hot.
    """
    left = pairs.drop(*LABEL_COLUMNS).withColumn("_pair", F.lit(True))
    right = means.select("row_id", *PROBABILITY_COLUMNS).withColumn("_pred", F.lit(True))
    met = left.join(right, "row_id", "full")
    stop = F.raise_error(
        F.concat(F.lit("pairs and predictions differ at row "), F.col("row_id").cast("string"))
    ).cast("double")
    whole = F.col("_pair").isNotNull() & F.col("_pred").isNotNull()
    labels = {
        label: F.when(whole, F.col(name)).otherwise(stop)
        for label, name in zip(LABEL_COLUMNS, PROBABILITY_COLUMNS)
    }
    return met.withColumns(labels).drop("_pair", "_pred", *PROBABILITY_COLUMNS)


def concat_sources(*sources: DataFrame) -> DataFrame:
    """Tables one after the other. `source_no` and the native id make the new row key.

    A row without a key ends the job: it could not be told from others.
    """
    numbered = [
        one.select(
            F.lit(number).alias("source_no"),
            *[c for c in one.columns if c != "row_id"],
            F.concat_ws(":", F.lit(number), present_key(F.col("row_id"))).alias("row_id"),
        )
        for number, one in enumerate(sources)
    ]
    whole = numbered[0]
    for one in numbered[1:]:
        whole = whole.unionByName(one)
    return whole
