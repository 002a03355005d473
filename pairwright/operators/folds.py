"""Stratified folds that keep every prompt whole."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import label_index
from pairwright.functions.turns import key_text, seeded_hash
from pairwright.operators.joins import salted_join
from pairwright.operators.ranks import hash_digits, rank_within, running_before
from pairwright.operators.skew import HOT_ROWS
from pairwright.staging import stage

STRATUM = ("n_a", "n_b", "n_tie")

# Tasks that share the prompts of one stratum when these meet what lies before them.
SPREAD = 64
# Prompts that are dealt one by one, those with the most rows: the driver sees that many rows of five numbers.
# Any other prompt of several rows holds less than one in so many of such prompts' rows.
BIG_PROMPTS = 4096


def prompt_groups(pairs: DataFrame) -> DataFrame:
    """(prompt_key, n_a, n_b, n_tie, n_rows): the class counts of each prompt."""
    label = label_index()
    return pairs.groupBy("prompt_key").agg(
        *[F.count_if(label == position).alias(name) for position, name in enumerate(STRATUM)],
        F.count("*").alias("n_rows"),
    )


def _hash_ranked(groups: DataFrame, keys: Sequence[str], seed: int, n_groups: int) -> DataFrame:
    """`_rank`: 1-based place of a prompt among those with equal `keys`, by seeded hash."""
    digits = hash_digits(n_groups)
    hashed = groups.withColumn("_hash", _prompt_hash(seed))
    return rank_within(
        hashed,
        keys=keys,
        order=["_hash", "prompt_key"],
        bucket=F.substring("_hash", 1, digits),
        rank="_rank",
        size="_size",
        digits=digits,
    ).drop("_hash", "_size")


def _prompt_hash(seed: int) -> Column:
    return seeded_hash(seed, key_text(F.col("prompt_key")))


def _least_deviation(vectors: Iterable[Sequence[int]], k: int) -> list[int]:
    """The fold of each vector, one after the other: where the squared deviation of all folds grows least.

    The sum of the vectors is given, so that is the fold whose load has the least product with the
    vector; of equals the emptier one, then the first.
    """
    loads = [[0] * (len(STRATUM) + 1) for _ in range(k)]
    dealt = []
    for vector in vectors:
        fold = min(
            range(k), key=lambda f: (sum(load * one for load, one in zip(loads[f], vector)), loads[f][-1], f)
        )
        loads[fold] = [load + one for load, one in zip(loads[fold], vector)]
        dealt.append(fold)
    return dealt


def _big_dealt(several: DataFrame, k: int, seed: int, big: int) -> DataFrame:
    """(prompt_key, fold) of the `big` prompts with the most rows: that many rows of numbers pass the driver."""
    first = (
        several.withColumn("_hash", _prompt_hash(seed))
        .orderBy(F.desc("n_rows"), "_hash", "prompt_key")
        .limit(big)
        .collect()
    )
    folds = _least_deviation(([row[name] for name in (*STRATUM, "n_rows")] for row in first), k)
    rows = [(bytes(row["prompt_key"]), fold) for row, fold in zip(first, folds)]
    return several.sparkSession.createDataFrame(rows, "prompt_key binary, fold int")


def _dealt_round(several: DataFrame, k: int, seed: int, n_groups: int) -> DataFrame:
    """Prompts of several rows with their fold, dealt one after the other in the order of their strata.

    A stratum is what has the same number of rows of each class. Strata follow each other by falling size and,
    there and back, by their classes, so that neighbours are alike and every k of them differ little.
    """
    back = F.when(F.col("n_rows") % 2 == 0, F.col("n_a")).otherwise(-F.col("n_a"))
    forth = F.when(F.col("n_a") % 2 == 0, F.col("n_b")).otherwise(-F.col("n_b"))
    strata = several.groupBy(*STRATUM, "n_rows").agg(F.count("*").alias("_n")).select(
        *STRATUM, (-F.col("n_rows")).alias("_falling"), back.alias("_back"), forth.alias("_forth"), "_n"
    )
    # Nearly all prompts may be of one stratum, so each is there once per piece.
    starts = running_before(strata, ["_falling", "_back", "_forth"], "_n", "_start").select(
        *STRATUM, "_start", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_piece")
    )
    ranked = _hash_ranked(several, list(STRATUM), seed, n_groups).withColumn(
        "_piece", F.pmod(F.xxhash64("prompt_key"), F.lit(SPREAD)).cast("int")
    )
    fold = F.pmod(F.col("_start") + F.col("_rank") - 1, F.lit(k)).cast("int")
    return ranked.join(starts, [*STRATUM, "_piece"]).select("prompt_key", *STRATUM, "n_rows", fold.alias("fold"))


def _dealt_by_rows(several: DataFrame, k: int, seed: int, n_several: int, big: int) -> DataFrame:
    """Prompts of several rows with their fold: the biggest by least deviation, the others in turn."""
    # As many rows as `big` says.
    first = F.broadcast(_big_dealt(several, k, seed, big))
    columns = ("prompt_key", *STRATUM, "n_rows", "fold")
    dealt = several.join(first, "prompt_key").select(*columns)
    if n_several <= big:
        return dealt
    rest = several.join(first.select("prompt_key"), "prompt_key", "left_anti")
    return dealt.unionByName(_dealt_round(rest, k, seed, n_several))


def _fill(held: Sequence[int], amount: int) -> list[int]:
    """How much of `amount` goes to the folds up to each one, without the last, so that all rise to one level.

    A fold that is above the level already gets nothing.
    """
    level = min((amount + below) / folds for folds, below in enumerate(accumulate(sorted(held)), 1))
    gaps = [max(0.0, level - one) for one in held]
    return [math.floor(running + 1e-9) for running in list(accumulate(gaps))[:-1]]


def _passed(value: Column, limits: Sequence[int]) -> Column:
    """How many of the ascending `limits` the value has passed."""
    return reduce(add, [(value > one).cast("int") for one in limits], F.lit(0))


def _loads(dealt: DataFrame, k: int) -> list[dict[str, int]]:
    """Class counts per fold: k rows of three numbers, all that the driver sees."""
    sums = dealt.groupBy("fold").agg(*[F.sum(name).alias(name) for name in STRATUM])
    found = {row["fold"]: row for row in sums.collect()}
    return [
        {name: found[fold][name] if fold in found else 0 for name in STRATUM}
        for fold in range(k)
    ]


def group_folds(groups: DataFrame, k: int = 5, seed: int = 0, big: int = BIG_PROMPTS) -> DataFrame:
    """(prompt_key, n_a, n_b, n_tie, n_rows, fold) from `prompt_groups`, one row per prompt.

    The `big` prompts with the most rows go, by falling size, where the squared deviation of rows and classes from
    even folds grows least; other prompts of several rows are dealt in turn, stratum after stratum; the
    one-row prompts of each class then fill the folds up to one level of that class.
    """
    singles = [
        F.count_if((F.col("n_rows") == 1) & (F.col(name) == 1)).alias(f"single_{name}")
        for name in STRATUM
    ]
    whole = groups.agg(*singles, F.count_if(F.col("n_rows") > 1).alias("several")).first()
    dealt = _dealt_by_rows(groups.where("n_rows > 1"), k, seed, whole["several"], big)
    several = stage(dealt, "several")
    held = _loads(several, k)
    fold = F.lit(0)
    for name in STRATUM:
        ranked = _passed(F.col("_rank"), _fill([one[name] for one in held], whole[f"single_{name}"]))
        fold = F.when(F.col(name) == 1, ranked).otherwise(fold)
    n_singles = sum(whole[f"single_{name}"] for name in STRATUM)
    alone = _hash_ranked(groups.where("n_rows = 1"), list(STRATUM), seed, n_singles)
    filled = alone.select("prompt_key", *STRATUM, "n_rows", fold.cast("int").alias("fold"))
    return several.unionByName(filled)


def assign_folds(
    pairs: DataFrame, k: int = 5, seed: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Pairs with their fold.

    `pairs` is read twice, so hand in a written table. The class counts per
    prompt are staged: five numbers that several steps go over.
    """
    groups = stage(prompt_groups(pairs), "prompt-groups")
    return salted_join(
        pairs,
        group_folds(groups, k, seed).select("prompt_key", "fold"),
        "prompt_key",
        "inner",
        ["id"],
        hot_rows=hot_rows,
        counts=groups.select("prompt_key", "n_rows"),
    )


def fold_sizes(pairs: DataFrame) -> DataFrame:
    """Rows per fold and class."""
    label = label_index()
    return pairs.groupBy("fold").agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(label == position).alias(name) for position, name in enumerate(STRATUM)],
    )


def filter_rows(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows that meet a predicate given as text, such as "fold != 0".

    This is SQL: a comparison with null is not met, so rows without a fold are on neither side.
    `training_rows` takes them in.
    """
    return df if predicate is None else df.where(F.expr(predicate))


def training_rows(df: DataFrame, fold: int) -> DataFrame:
    return filter_rows(df, f"NOT (fold <=> {fold})")


def validation_rows(df: DataFrame, fold: int) -> DataFrame:
    return filter_rows(df, f"fold == {fold}")
