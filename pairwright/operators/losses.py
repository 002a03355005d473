"""Losses over whole tables, and the smoothed training loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.labels import FLOAT32_EPSILON, row_cross_entropy, row_log_loss

# Steps per piece of a run; see `rolling_loss`.
PIECE_STEPS = 65_536


def log_loss(
    df: DataFrame,
    labels: Sequence[Column],
    probabilities: Sequence[Column],
    by: Sequence[str] = (),
    eps: float = FLOAT32_EPSILON,
) -> DataFrame:
    """Mean log loss, per `by` group if given."""
    rows = df.select(*by, row_log_loss(labels, probabilities, eps).alias("_loss"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_loss").alias("log_loss"))


def micro_batch_loss(
    df: DataFrame, labels: Sequence[Column], logits: Sequence[Column], by: Sequence[str]
) -> DataFrame:
    """Mean soft cross entropy and sample count of each micro batch."""
    rows = df.select(*by, row_cross_entropy(labels, logits).alias("_loss"))
    return rows.groupBy(*by).agg(F.avg("_loss").alias("loss"), F.count("*").alias("n"))


def weighted_loss(micro_batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """sum(loss * n) / sum(n): the plain mean over samples."""
    return micro_batches.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss")
    )


def rolling_loss(
    metrics: DataFrame, window: int = 100, every: int = 1, piece: int = PIECE_STEPS
) -> DataFrame:
    """Mean of a run's last `window` losses at each `every`-th step.

    `metrics` is (run_id, step, loss) with steps 1, 2, 3 … in each run. A run is
    cut into pieces of `piece` steps that different tasks smooth; a piece also
    gets the `window - 1` steps before it, so its first means are whole.
    """
    if window - 1 > piece:
        raise ValueError("a piece must hold at least window - 1 steps")
    own = F.floor((F.col("step") - 1) / piece)
    near_end = F.pmod(F.col("step") - 1, F.lit(piece)) >= piece - (window - 1)
    pieces = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = metrics.select(
        "run_id", "step", "loss", own.alias("_own"), F.explode(pieces).alias("_piece")
    )
    last = (
        Window.partitionBy("run_id", "_piece").orderBy("step").rowsBetween(-(window - 1), 0)
    )
    smoothed = spread.withColumn("mean_loss", F.avg("loss").over(last))
    return smoothed.where(
        (F.col("_own") == F.col("_piece")) & (F.pmod("step", F.lit(every)) == 0)
    ).select("run_id", "step", "loss", "mean_loss")
