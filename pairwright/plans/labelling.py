"""Soft labels: the mean of several scorers in place of the labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import token_count
from pairwright.operators.scoring import Scorer, mean_probabilities
from pairwright.schemas import LABEL_COLUMNS, PROBABILITY_COLUMNS


def pseudo_label(
    pairs: DataFrame, scorers: Mapping[str, Scorer], inputs: Sequence[str]
) -> DataFrame:
    """`pairs` with the scorers' mean probabilities as labels, in one pass.

    Predictions that come from files are attached by key: `ensemble_mean`, `attach_predictions`.
    """
    scored = pairs.withColumn("_mean", mean_probabilities(scorers, inputs))
    labels = {label: F.col(f"_mean.{name}") for label, name in zip(LABEL_COLUMNS, PROBABILITY_COLUMNS)}
    return scored.withColumns(labels).drop("_mean")


# What the length scorers read: numbers, so no text goes to Python.
LENGTH_INPUTS = ("tokens_a", "tokens_b")


def with_lengths(pairs: DataFrame) -> DataFrame:
    """Token counts of both answers over all turns."""
    return pairs.withColumns(
        {
            f"tokens_{side}": token_count(F.array_join(f"response_{side}", "\n", "null"))
            for side in "ab"
        }
    )


def length_scorer(weight: float, tie: float) -> Scorer:
    """Prefers the longer answer; the simplest scorer there is, for trial runs."""

    def scorer(frame: pd.DataFrame) -> np.ndarray:
        gap = np.log1p(frame["tokens_a"].to_numpy("float64")) - np.log1p(
            frame["tokens_b"].to_numpy("float64")
        )
        return np.stack([weight * gap, -weight * gap, np.full(len(frame), tie)], axis=1)

    return scorer
