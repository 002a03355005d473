"""Joins that stand a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.skew import HOT_ROWS, hot_keys, key_counts


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_by: Sequence[str | Column],
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join `left` to `right` on `key`, which must be unique in `right`.

    Rows of a hot key go to several tasks by the hash of `spread_by` and meet a
    copy of the one `right` row there; all other keys keep piece 0. A piece is
    about `hot_rows` rows, so `right` grows by one row per `hot_rows` rows of
    `left`, and HOT_KEYS more at most. `how` is inner, left, left_semi or
    left_anti. Pass `counts` (key, n_rows) of `left` when they are at hand.
    """
    if counts is None:
        counts = key_counts(left, [key])
    pieces = F.ceil(F.col("n_rows") / hot_rows).cast("int")
    # HOT_KEYS rows by construction, whatever the data.
    hot = F.broadcast(
        hot_keys(counts, [key], hot_rows).select(F.col(key), pieces.alias("_pieces"))
    )
    own = F.pmod(F.xxhash64(*spread_by), F.col("_pieces")).cast("int")
    spread = (
        left.join(hot, key, "left")
        .withColumn("_piece", F.when(F.col("_pieces").isNull(), 0).otherwise(own))
        .drop("_pieces")
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    copied = right.join(hot, key, "left").withColumn("_piece", F.explode(copies)).drop("_pieces")
    return spread.join(copied, [key, "_piece"], how).drop("_piece")
