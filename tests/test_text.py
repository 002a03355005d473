"""Token rules and rendering on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from pairwright.functions.templates import (
    JOINT,
    LOCALIZED,
    MARKUP,
    SPLIT,
    Template,
    judge_text,
    judged_length,
    render,
    turn_tokens,
)
from pairwright.functions.text import token_count, truncate_tokens
from pairwright.functions.turns import decode_turns, encode_turns
from pairwright.operators.augment import (
    TURN_COUNTS,
    flatten_samples,
    sample_texts,
    with_sample_lengths,
    with_turn_counts,
)
from pairwright.operators.scoring import tokens_of

TEXTS = [
    "", " ", "a", " a ", "a b", "a  b\t\nc\r\nd ", "\n\nlead", "trail\n", "é à\u000bç d\u00a0e",
    "word " * 5000, "x" * 10_000, "\n### User:\nq\n\n### Assistant A:\na\n",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")


def test_token_count(texts):
    found = {r.n: r.c for r in texts.select("n", token_count(F.col("text")).alias("c")).collect()}
    assert found == {i: len(re.findall(r"[^ \t\n\r]+", t)) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 100])
def test_truncation(texts, limit):
    cut = truncate_tokens(F.col("text"), limit).alias("c")
    found = {r.n: r.c for r in texts.select("n", cut).collect()}
    for n, text in enumerate(TEXTS):
        words = re.findall(r"[ \t\n\r]*[^ \t\n\r]+", text)
        expected = text if len(words) <= limit else "".join(words[:limit])
        assert found[n] == expected


def test_truncation_does_not_look_at_the_tail(spark):
    """The split stops behind the last token kept."""
    plan = spark.range(1).select(truncate_tokens(F.concat(F.lit("a b"), F.col("id").cast("string")), 100))
    found = plan._jdf.queryExecution().analyzed().toString()
    assert "split(" in found and ", 101)" in found and "regexp_extract_all" not in found


PAIRS = [
    (["q1", "q2"], ["a1", "a2"], ["b1", "b2"]),
    ([None], ["a"], [None]),
    (["q1", "q2"], ["a1"], ["b1", "b2"]),
    ([], [], []),
    (["q1"], ["a1", "a2"], ["b1"]),
]


def blocks(*shown):
    return "".join(
        f"\n### {label}:\n{'null' if text is None else text}\n" for label, text in shown
    )


def by_hand(template, row):
    turns = list(zip(*row))
    labels = (template.user_label, template.a_label, template.b_label)
    if template.joint:
        body = "".join(blocks(*zip(labels, turn)) for turn in turns)
        return template.head + body + template.tail
    a = "".join(blocks((labels[0], p), (labels[1], x)) for p, x, _ in turns)
    b = "".join(blocks((labels[0], p), (labels[2], y)) for p, _, y in turns)
    return template.head + a + template.separator + b + template.tail


@pytest.mark.parametrize("template", [JOINT, SPLIT, LOCALIZED], ids=lambda t: t.name)
def test_rendering(spark, template):
    table = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(PAIRS)],
        "n int, p array<string>, a array<string>, b array<string>",
    )
    text = render(template, F.col("p"), F.col("a"), F.col("b")).alias("t")
    found = {r.n: r.t for r in table.select("n", text).collect()}
    assert found == {i: by_hand(template, row) for i, row in enumerate(PAIRS)}


def test_sides_are_cut_apart_and_head_and_tail_stay(spark):
    table = spark.createDataFrame([(["q " * 50], ["a " * 50], ["b " * 50])], "p array<string>, a array<string>, b array<string>")
    columns = [F.col(c) for c in "pab"]
    joint = table.select(render(JOINT, *columns, max_length=20).alias("t")).first().t
    split = table.select(render(SPLIT, *columns, max_length=20).alias("t")).first().t
    assert joint.startswith(JOINT.head) and joint.endswith(JOINT.tail)
    assert len(joint[len(JOINT.head):-len(JOINT.tail)].split()) == 20
    a, b = split[len(SPLIT.head):-len(SPLIT.tail)].split(SPLIT.separator)
    assert len(a.split()) == len(b.split()) == 10


def test_system_role_and_prefix(spark):
    table = spark.createDataFrame([(["q"], ["a"], ["b"])], "p array<string>, a array<string>, b array<string>")
    columns = [F.col(c) for c in "pab"]
    conversation = by_hand(JOINT, (["q"], ["a"], ["b"]))
    opening = MARKUP.opening.format
    end = MARKUP.closing + opening(role="assistant") + JOINT.suffix
    own = table.select(judge_text(JOINT, *columns, system_role=True).alias("t")).first().t
    assert own == (
        opening(role="system") + JOINT.instruction + MARKUP.closing
        + opening(role="user") + conversation + end
    )
    prefixed = table.select(judge_text(JOINT, *columns, system_role=False).alias("t")).first().t
    assert prefixed == opening(role="user") + JOINT.instruction + "\n" + conversation + end


def test_turn_lists_survive_json(spark):
    lists = [['say "hi"', None, "line\nbreak", "tab\t", "é漢😀", "back\\slash", ""], []]
    table = spark.createDataFrame([(one,) for one in lists], "t array<string>")
    back = table.select(decode_turns(encode_turns(F.col("t"))).alias("t")).collect()
    assert [r.t for r in back] == lists
    spaced = spark.createDataFrame([('["a", "\\u00e9", null]',)], "j string")
    assert spaced.select(decode_turns(F.col("j")).alias("t")).first().t == ["a", "é", None]


@pytest.mark.parametrize("system_role", [True, False])
@pytest.mark.parametrize("max_length", [None, 0, 1, 2, 9, 14, 15, 16, 40, 4096])
def test_lengths_without_rendering(spark, max_length, system_role):
    rows = PAIRS + [
        (["q " * 9, "x"], ["a\tb\n", " "], ["", "\n\nend"]),
        (["", ""], ["", ""], [None, ""]),
    ]
    odd = Template("odd", False, "head ", " tail", "say", "go", "U", "long label A", "B", " mid ")
    table = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "n int, p array<string>, a array<string>, b array<string>",
    )
    sides = [F.col(c) for c in "pab"]
    turns = F.least(*[F.size(c) for c in "pab"])
    counts = [turn_tokens(one, turns) for one in sides]
    for template in (JOINT, SPLIT, LOCALIZED, odd):
        text = judge_text(template, *sides, max_length, system_role)
        length = judged_length(template, turns, *counts, max_length, system_role)
        found = table.select("n", token_count(text).alias("own"), length.alias("length"))
        assert [(r.n, r.length) for r in found.collect()] == [(r.n, r.own) for r in found.collect()]


def test_a_tokenizer_goes_through_rendering_and_measuring(spark):
    def tokenizer(texts, limit):
        found = texts.str.findall(r"\s*\S{1,3}")
        return found.map(lambda one: "".join(one[:limit])), found.map(len)

    tokens = tokens_of(tokenizer)
    rows = [("r1", ["abcdefgh ij", None], ["x" * 50, "y"], ["no", "yes yes"], 1.0, 0.0, 0.0), ("r2", [], ["a"], ["b"], 0.0, 0.0, 1.0)]
    pairs = spark.createDataFrame(
        rows, "row_id string, prompt array<string>, response_a array<string>, response_b array<string>, winner_model_a double, winner_model_b double, winner_tie double"
    )
    for limit in (None, 12):
        texts = sample_texts(pairs, [JOINT, SPLIT], max_length=limit, tokens=tokens)
        lengths = flatten_samples(with_sample_lengths(pairs, [JOINT, SPLIT], max_length=limit, tokens=tokens))
        want = {(r.row_id, r.variant_no): len(re.findall(r"\s*\S{1,3}", r.input_text)) for r in texts.collect()}
        assert {(r.row_id, r.variant_no): r.seq_len for r in lengths.collect()} == want
        assert len(want) == 8


def test_turn_counts_at_hand_are_not_counted_again(spark):
    pairs = spark.createDataFrame(
        [("r", ["a b"], ["c"], ["d e f"], 1.0, 0.0, 0.0)],
        "row_id string, prompt array<string>, response_a array<string>, response_b array<string>, winner_model_a double, winner_model_b double, winner_tie double",
    )
    counted = with_turn_counts(pairs)
    assert counted.select(*TURN_COUNTS).first() == (1, 2, 1, 3)
    own, again = (with_sample_lengths(one, [JOINT, SPLIT]).collect() for one in (pairs, counted))
    assert own == again
