"""A filter in front of a join: rows that cannot meet anything stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.staging import stage

# Bits per key: about one row in fifty passes without being among the keys.
BITS_PER_KEY = 16
# Sizes of a filter, in 64-bit words: 1 KB at least, 16 MB at most. That much is full at eight million keys; with many
# times more of them most rows pass, and nothing else changes.
LEAST_WORDS, MOST_WORDS = 1 << 7, 1 << 21


def filter_words(keys: int) -> int:
    """Words of the filter of so many keys: a power of two."""
    words = LEAST_WORDS
    while words < MOST_WORDS and words * 64 < keys * BITS_PER_KEY:
        words *= 2
    return words


def _mask(hashed: Column) -> Column:
    """Two bits of a word, from digits of the hash that do not say which word."""
    one = F.lit(1).cast("long")
    first, second = (F.shiftrightunsigned(hashed, digits).bitwiseAND(F.lit(63)).cast("int") for digits in (52, 58))
    return F.call_function("shiftleft", one, first).bitwiseOR(F.call_function("shiftleft", one, second))


def may_be_among(keys: DataFrame, column: str) -> Column:
    """Whether a row's `column` may be among those of `keys`: never a wrong no, a few wrong yeses.

    A Bloom filter of blocks of one word: a key's hash names a word and two bits in it. It is sized by the number of
    `keys`, which are run at once for that, so hand in a written table. It is a scalar of the plan, an array of longs of
    bounded size, and looked up in the JVM.
    """
    words = filter_words(keys.count())
    hashed = F.xxhash64(column)
    place = F.pmod(hashed, F.lit(words)).cast("int")
    held = keys.select(place.alias("place"), _mask(hashed).alias("mask")).groupBy("place").agg(F.bit_or("mask").alias("mask"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("place"))
    # MOST_WORDS rows at most.
    whole = every.join(held, "place", "left").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("all")
    )
    # Written, so that each place where the filter is used reads one row.
    bits = stage(whole.select(F.transform("all", lambda one: one["mask"]).alias("bits")), "filter").scalar()
    return F.get(bits, place).bitwiseAND(_mask(hashed)) == _mask(hashed)
