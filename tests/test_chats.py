"""Role split, validation and corpus conversion on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from pairwright.operators.chats import check_chats, check_turns, nest_turns, split_chats, split_roles
from pairwright.operators.preference import (
    check_corpus,
    convert_corpus,
    corpus_to_pairs,
    with_placeholder_labels,
)
from pairwright.schemas import CHAT_LOG, CORPUS


def turn(role, content):
    return {"role": role, "content": content}


CASES = {
    None: [turn("user", "q"), turn("assistant", "a")],
    "bad_role": [turn("system", "s"), turn("user", "q"), turn("assistant", "a")],
    "bad_text": [turn("user", None), turn("assistant", "a")],
    "no_user_turn": [turn("assistant", "a")],
    "count_mismatch": [turn("user", "q"), turn("assistant", "a"), turn("user", "more")],
}


def test_every_reason(spark):
    rows = [(str(reason), conversation) for reason, conversation in CASES.items()]
    checked = check_chats(spark.createDataFrame(rows, CHAT_LOG))
    assert {r.model: str(r.reason) for r in checked.collect()} == {str(r): str(r) for r in CASES}


def test_turn_rows_are_judged_alike(spark):
    rows = [
        (str(reason), i, one["role"], one["content"])
        for reason, conversation in CASES.items()
        for i, one in enumerate(conversation)
    ]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    found = {r.conv_id: str(r.reason) for r in check_turns(turns).collect()}
    assert found == {str(r): str(r) for r in CASES}


def test_null_role_is_a_bad_role(spark):
    chats = spark.createDataFrame([("m", [turn(None, "x"), turn("user", "q")])], CHAT_LOG)
    assert check_chats(chats).first().reason == "bad_role"


def test_fail_mode_stops_the_job(spark):
    chats = spark.createDataFrame([("m", CASES["bad_role"])], CHAT_LOG)
    with pytest.raises(Exception, match="unfit conversation: bad_role"):
        check_chats(chats, "fail").collect()
    good = spark.createDataFrame([("m", CASES[None])], CHAT_LOG)
    assert check_chats(good, "fail").first().reason is None


def test_split_keeps_turn_order(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(20)]
    turns = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    row = split_roles(nest_turns(turns)).first()
    assert row.prompt == [f"t{i}" for i in range(0, 20, 2)]
    assert row.response == [f"t{i}" for i in range(1, 20, 2)]


@pytest.mark.parametrize("first", [0, 1])
def test_long_conversations_stay_whole(spark, first):
    turns = spark.range(300).select(
        F.lit(1).alias("conv_id"),
        (F.col("id") + first).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    (chat,) = check_chats(nest_turns(turns)).collect()
    assert [int(t.content) for t in chat.conversation] == list(range(300))
    (counted,) = check_turns(turns).collect()
    assert chat.reason is None and counted.reason is None
    assert len(split_roles(nest_turns(turns)).first().prompt) == 150


def test_corpus_conversion(spark):
    chosen = [turn("user", "q1"), turn("assistant", "good"), turn("user", "q2"),
              turn("assistant", "fine")]
    rejected = [turn("user", "q1"), turn("assistant", "bad"), turn("user", "q2"),
                turn("assistant", "worse"), turn("assistant", "beyond the chosen side")]
    rows = [(str(i), chosen, rejected) for i in range(200)]
    rows.append(("short", chosen, rejected[:2]))
    corpus = spark.createDataFrame(rows, CORPUS)
    assert [r.row_id for r in check_corpus(corpus).where("reason is not null").collect()] == ["short"]
    with pytest.raises(Exception, match="unfit corpus row: short_rejected"):
        corpus_to_pairs(corpus, seed=7).collect()
    made, split = convert_corpus(corpus, seed=7)
    assert (split.n_fit, split.n_unfit) == (200, 1)
    assert [(r.row_id, r.reason) for r in split.unfit.collect()] == [("short", "short_rejected")]
    pairs = made.collect()
    assert len(pairs) == 200
    at_a = 0
    for row in pairs:
        preferred, other = (
            (row.response_a, row.response_b)
            if row.winner_model_a == 1
            else (row.response_b, row.response_a)
        )
        assert row.prompt == ["q1", "q2"]
        assert preferred == ["good", "fine"] and other == ["bad", "worse"]
        assert row.winner_model_a + row.winner_model_b == 1 and row.winner_tie == 0
        assert (row.id, row.model_a, row.model_b) == ("a", "a", "a")
        at_a += row.winner_model_a
    assert 60 < at_a < 140


def test_split_chats_add_up(spark):
    good = [turn("user", "q"), turn("assistant", "a")]
    rows = [("m", good if i % 3 else good[:1]) for i in range(30)]
    chats = spark.createDataFrame(rows, CHAT_LOG)
    split = split_chats(chats)
    assert (split.n_fit, split.n_unfit) == (20, 10)
    assert {(tuple(r.prompt), tuple(r.response)) for r in split.fit.collect()} == {(("q",), ("a",))}
    assert {r.reason for r in split.unfit.collect()} == {"count_mismatch"}
    assert split.unfit.drop("reason").columns == chats.columns
    none = split_chats(chats.where("false"))
    assert (none.n_fit, none.n_unfit, none.fit.count(), none.unfit.count()) == (0, 0, 0, 0)


def test_quarantine_notices_missing_rows(spark, monkeypatch):
    """Sides that do not add up to what the pass read end the job."""
    from pairwright.operators import quarantine

    checked = check_chats(spark.createDataFrame([("m", [turn("user", "q"), turn("assistant", "a")])], CHAT_LOG))
    real = quarantine.Observation.get.fget
    monkeypatch.setattr(quarantine.Observation, "get", property(lambda self: {**real(self), "n_rows": 2}))
    with pytest.raises(RuntimeError, match="1 and 0 rows written"):
        quarantine.split_checked(checked)


def test_placeholder_labels(spark):
    row = with_placeholder_labels(spark.range(1)).first()
    assert (row.winner_model_a, row.winner_model_b, row.winner_tie) == (1.0, 0.0, 0.0)
