"""Pairs of answers that different models gave to the same prompt.

A candidate row is (row_id, model, prompt, response) with list-valued prompt
and response. All planning runs on 32-byte digests of the texts; the texts
themselves are read a second time, for the chosen rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.turns import key_text, seeded_hash, turns_key
from pairwright.operators.filters import may_be_among
from pairwright.operators.joins import salted_join
from pairwright.operators.ranks import rank_within
from pairwright.operators.skew import HOT_ROWS, key_counts
from pairwright.staging import stage


def candidate_keys(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Digests in place of texts. Narrow: no shuffle."""
    return rows.select(
        "row_id",
        "model",
        turns_key(F.col("prompt")).alias("prompt_key"),
        turns_key(F.col("response")).alias("response_key"),
        *carry,
    )


def prompt_counts(keys: DataFrame) -> DataFrame:
    """Rows per prompt."""
    return key_counts(keys, ["prompt_key"])


def attach_prompt_counts(keys: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each row with the number of rows of its prompt, as `n_pid`."""
    counts = prompt_counts(keys)
    renamed = counts.withColumnRenamed("n_rows", "n_pid")
    return salted_join(
        keys, renamed, "prompt_key", "inner", ["row_id"], hot_rows=hot_rows, counts=counts
    )


def repeated_prompts(counted: DataFrame) -> DataFrame:
    """Rows whose prompt was seen more than once."""
    return counted.where(F.col("n_pid") > 1)


def dedup_keys(keys: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """First row per (prompt, response), whatever the model.

    Copies are dropped before the shuffle, so a text that fills a third of the
    table sends one row per task.
    """
    first = F.min(F.struct("row_id", "model", *carry)).alias("_first")
    return (
        keys.groupBy("prompt_key", "response_key")
        .agg(first)
        .select("prompt_key", "response_key", "_first.*")
    )


def dedup_first(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Whole rows: the first per (prompt, response) by `row_id`.

    The copies are found by digests, a digest that very many rows have by many tasks. Rows that cannot be a later
    copy, by a filter of those, stay where they are; only the others meet the list of later copies.
    """
    both = turns_key(F.concat(F.array(F.to_json("prompt")), F.col("response")))
    keys = rows.select("row_id", both.alias("_key"))
    several = stage(
        keys.groupBy("_key").agg(F.min("row_id").alias("_first"), F.count("*").alias("n_rows")).where("n_rows > 1"), "copied"
    )
    firsts = salted_join(
        keys, several.select("_key", "_first"), "_key", "inner", ["row_id"], hot_rows=hot_rows, counts=several.select("_key", "n_rows")
    )
    later = stage(firsts.where("row_id <> _first").select("row_id"), "later-copies")
    may_be_later = may_be_among(later, "row_id")
    return rows.where(~may_be_later).unionByName(rows.where(may_be_later).join(later, "row_id", "left_anti"))


def first_per_model(keys: DataFrame, seed: int, carry: Sequence[str] = ()) -> DataFrame:
    """First row of each model within a prompt, in seeded shuffle order.

    `shuffle_key` also orders the models: by their first appearance.
    """
    payload = F.struct(
        seeded_hash(seed, F.col("row_id")).alias("shuffle_key"), "row_id", "response_key", *carry
    )
    return (
        keys.groupBy("prompt_key", "model")
        .agg(F.min(payload).alias("_first"))
        .select("prompt_key", "model", "_first.*")
    )


def pair_plan(
    keys: DataFrame, seed: int = 42, carry: Sequence[str] = ()
) -> DataFrame:
    """Which row meets which: models 1 and 2 of a prompt, 3 and 4, and so on.

    Columns: id, prompt_key, pair_no, row_a, row_b, model_a, model_b and, per
    carried column c, c_a and c_b. Each (prompt, model) is in one pair at most;
    an odd model is left over.
    """
    firsts = first_per_model(dedup_keys(keys, carry), seed, carry)
    # A prompt answered by very many models is numbered in up to 4,096 slots.
    ranked = rank_within(
        firsts,
        keys=["prompt_key"],
        order=["shuffle_key", "row_id"],
        bucket=F.substring("shuffle_key", 1, 3),
        rank="model_no",
        size="n_models",
    ).where(F.col("n_models") >= 2)
    member = F.struct("model_no", "row_id", "model", "response_key", *carry)
    pair_no = F.expr("(model_no - 1) div 2")
    met = (
        ranked.groupBy("prompt_key", pair_no.alias("pair_no"))
        .agg(
            F.min(member).alias("_a"),
            F.max(member).alias("_b"),
            F.count("*").alias("_n"),
        )
        .where((F.col("_n") == 2) & (F.col("_a.response_key") != F.col("_b.response_key")))
    )
    carried = [F.col(f"_{side}.{c}").alias(f"{c}_{side}") for c in carry for side in "ab"]
    return met.select(
        F.concat_ws("_", key_text(F.col("prompt_key")), F.col("pair_no")).alias("id"),
        "prompt_key",
        "pair_no",
        F.col("_a.row_id").alias("row_a"),
        F.col("_b.row_id").alias("row_b"),
        F.col("_a.model").alias("model_a"),
        F.col("_b.model").alias("model_b"),
        *carried,
    )


def fetch_texts(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Add prompt, response_a and response_b to a pair plan.

    One pass over `rows`: both sides are looked up together and folded back by
    pair, side A bringing the plan's columns along. A candidate row belongs to
    one pair at most, so no key is hot. The plan holds no texts and is written
    first: a filter made of its rows keeps the texts of all others from being
    moved.
    """
    plan = stage(plan, "pair-plan")
    at_a = F.col("side") == "a"
    sides = plan.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).select(
        "id",
        "side",
        F.when(at_a, F.col("row_a")).otherwise(F.col("row_b")).alias("row_id"),
        F.when(at_a, F.struct(*plan.columns)).alias("_plan"),
    )
    chosen = plan.select(F.col("row_a").alias("row_id")).union(plan.select("row_b"))
    texts = rows.where(may_be_among(chosen, "row_id")).select("row_id", "prompt", "response")
    found = sides.join(texts, "row_id")

    def of(side: str, column: str) -> Column:
        return F.any_value(F.when(F.col("side") == side, F.col(column)), F.lit(True))

    texts = found.groupBy("id").agg(
        F.any_value("_plan", F.lit(True)).alias("_plan"),
        of("a", "prompt").alias("prompt"),
        of("b", "prompt").alias("_prompt_b"),
        of("a", "response").alias("response_a"),
        of("b", "response").alias("response_b"),
    )
    # Equal keys must mean equal prompts, and both answers a turn per prompt turn.
    sound = (
        (F.col("prompt") == F.col("_prompt_b"))
        & (F.size("prompt") == F.size("response_a"))
        & (F.size("prompt") == F.size("response_b"))
    )
    prompt = F.when(sound, F.col("prompt")).otherwise(
        F.raise_error(F.lit("the two rows of a pair do not belong together"))
    )
    return texts.select("_plan.*", prompt.alias("prompt"), "response_a", "response_b")


def mine_pairs(rows: DataFrame, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """Candidate rows to pairs with texts."""
    return fetch_texts(pair_plan(candidate_keys(rows, carry), seed, carry), rows)


def exclude_prompts(pairs: DataFrame, known: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs whose whole prompt is not among `known.prompt_key`."""
    return salted_join(
        pairs,
        known.select("prompt_key").distinct(),
        "prompt_key",
        "left_anti",
        ["id"],
        hot_rows=hot_rows,
    )


def prompt_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Prompts found on both sides; each side is made distinct before they meet."""
    return (
        left.select("prompt_key")
        .distinct()
        .join(right.select("prompt_key").distinct(), "prompt_key", "left_semi")
    )
