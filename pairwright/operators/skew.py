"""Which keys hold so many rows that one task should not have them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 100_000
# Length of the list of keys to spread: a few megabytes to broadcast, whatever
# the data. A key that is not among the biggest hundred thousand holds at most
# a hundred-thousandth of the rows, so it needs no spreading. This bounds the
# list; it never leaves a row out of a result.
HOT_KEYS = 100_000


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, counted before they are shuffled."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def hot_keys(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The (keys, n_rows) worth spreading: HOT_KEYS rows at most, so fit to broadcast."""
    return (
        counts.where(F.col("n_rows") > hot_rows)
        .orderBy(F.desc("n_rows"), *keys)
        .limit(HOT_KEYS)
        .select(*keys, "n_rows")
    )
