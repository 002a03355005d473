"""Chat logs: nesting, role split, validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.turns import texts_of
from pairwright.operators.quarantine import Split, split_checked

# The two roles a chat may have.
ROLES = ("user", "assistant")


def nest_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, conversation), one row per conversation.

    A conversation is one row wherever it is kept, so its list is bounded by what a row may hold.
    """
    item = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    return (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(
            "conv_id",
            F.transform(
                "_items",
                lambda one: F.struct(one["role"].alias("role"), one["content"].alias("content")),
            ).alias("conversation"),
        )
    )


def split_roles(chats: DataFrame) -> DataFrame:
    """Add `prompt` (user texts) and `response` (assistant texts)."""
    conversation = F.col("conversation")
    return chats.withColumns(
        {"prompt": texts_of(conversation, "user"), "response": texts_of(conversation, "assistant")}
    )


def _reason(bad_role: Column, bad_text: Column, n_user: Column, n_assistant: Column) -> Column:
    return (
        F.when(bad_role, "bad_role")
        .when(bad_text, "bad_text")
        .when(n_user == 0, "no_user_turn")
        .when(n_user != n_assistant, "count_mismatch")
    )


def chat_reason(conversation: Column) -> Column:
    """Why a nested conversation is unfit for pairing; null if it is fit."""
    return _reason(
        F.exists(conversation, lambda turn: ~F.coalesce(turn["role"].isin(*ROLES), F.lit(False))),
        F.exists(conversation, lambda turn: turn["content"].isNull()),
        F.size(texts_of(conversation, "user")),
        F.size(texts_of(conversation, "assistant")),
    )


def check_chats(chats: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Add `reason`; `split_chats` parts the rows by it. In mode "fail" the first unfit conversation ends the job."""
    checked = chats.withColumn("reason", chat_reason(F.col("conversation")))
    if mode == "quarantine":
        return checked
    if mode == "fail":
        stop = F.raise_error(F.concat(F.lit("unfit conversation: "), F.col("reason")))
        return checked.withColumn(
            "reason", F.when(F.col("reason").isNotNull(), stop.cast("string"))
        )
    raise ValueError(f"mode is 'quarantine' or 'fail', not {mode!r}")


def split_chats(chats: DataFrame) -> Split:
    """Conversations that are fit for pairing, with `prompt` and `response`, and those that are not, with the reason."""
    split = split_checked(check_chats(chats), "chats")
    return replace(split, fit=split_roles(split.fit))


def check_turns(turns: DataFrame) -> DataFrame:
    """The same check on turn rows: counters only, combined before the shuffle."""

    def count_if(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    role = F.col("role")
    counted = turns.groupBy("conv_id").agg(
        count_if(role == "user").alias("n_user"),
        count_if(role == "assistant").alias("n_assistant"),
        F.count_if(~F.coalesce(role.isin(*ROLES), F.lit(False))).alias("n_bad_role"),
        F.count_if(F.col("text").isNull()).alias("n_bad_text"),
    )
    reason = _reason(
        F.col("n_bad_role") > 0, F.col("n_bad_text") > 0, F.col("n_user"), F.col("n_assistant")
    )
    return counted.select("conv_id", "n_user", "n_assistant", reason.alias("reason"))
