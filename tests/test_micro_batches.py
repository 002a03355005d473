"""Texts at their micro batches, tokenizers in one pass, scoring under a budget."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright.functions.templates import JOINT, LOCALIZED, SPLIT
from pairwright.functions.text import Tokens
from pairwright.functions.turns import seeded_hash
from pairwright.operators import packing
from pairwright.operators.augment import flatten_samples, sample_texts, variant_texts, with_sample_lengths
from pairwright.operators.packing import micro_batch_texts, ordered_batches, plan_batches, restore_order, seeded_batches
from pairwright.operators.scoring import score_micro_batches, tokens_of
from pairwright.schemas import LABEL_COLUMNS
from pairwright.staging import stage


def pairs(spark, rows=97):
    def words(n, name):
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(name), i)), " ")

    return spark.range(rows).select(
        F.format_string("%05d", "id").alias("row_id"),
        F.array(words(F.col("id") % 7 + 1, "p"), F.lit(None).cast("string")).alias("prompt"),
        F.array(words(F.col("id") % 23 + 1, "a"), F.lit("x")).alias("response_a"),
        F.array(words(F.col("id") % 11 + 1, "b"), F.lit("y")).alias("response_b"),
        *[(F.col("id") % 3 == i).cast("double").alias(name) for i, name in enumerate(LABEL_COLUMNS)],
    )


def letters():
    """A token is up to three characters of a word; not one that adds up over pieces of text."""

    def tokenizer(texts, limit):
        found = [re.findall(r"[ \t\n\r]*[^ \t\n\r]{1,3}", text or "") for text in texts]
        cut = [t if limit is None or len(one) <= limit else "".join(one[:limit]) for t, one in zip(texts, found)]
        return pd.Series(cut, dtype=object), pd.Series([len(one) for one in found])

    return tokenizer


def by_order(frame, training):
    samples = with_sample_lengths(frame, [JOINT, SPLIT], include_swap=training)
    batched = seeded_batches(stage(samples, "measured"), 10, 3) if training else ordered_batches(samples, 10)
    planned = stage(plan_batches(flatten_samples(batched), 4, 400, by_length=training), "plan")
    key = F.concat(seeded_hash(3, F.col("row_id")), F.col("row_id")) if training else F.col("row_id")
    return planned, key


@pytest.mark.parametrize("training", [True, False])
@pytest.mark.parametrize("homes", [1 << 14, 3, 1])
def test_texts_meet_at_their_batch(spark, monkeypatch, training, homes):
    """Every sample of the plan is there with its own text, however many ranges of batches there are."""
    monkeypatch.setattr(packing, "HOMES", homes)
    frame = pairs(spark)
    planned, key = by_order(frame, training)
    made = micro_batch_texts(planned, frame, key, variant_texts([JOINT, SPLIT], training))
    place = ["batch_id", "shard", "micro_batch", "row", "row_id", "variant_no", "is_pad"]
    found = made.select("batch_id", "shard", "micro_batch", F.inline("samples"))
    texts = sample_texts(frame, [JOINT, SPLIT], training).select("row_id", "variant_no", "input_text")
    want = planned.join(texts, ["row_id", "variant_no"]).select(*place, "input_text", "label")
    assert found.count() == want.count() > 0
    assert found.select(*place, "input_text", "label").exceptAll(want).count() == 0
    rows = made.select("samples").collect()
    assert all([one.row for one in row.samples] == sorted(one.row for one in row.samples) for row in rows)


def test_texts_move_once(spark):
    frame = stage(pairs(spark), "pairs")
    planned, key = by_order(frame, True)
    plan = micro_batch_texts(planned, frame, key, variant_texts([JOINT, SPLIT]))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "home" in exchanges[0] and "Join" not in plan


def test_a_planned_row_must_be_there(spark):
    frame = pairs(spark)
    planned, key = by_order(frame, False)
    made = micro_batch_texts(planned, frame.where("row_id <> '00042'"), key, variant_texts([JOINT, SPLIT], False))
    with pytest.raises(Exception, match="planned row without a pair: 00042"):
        made.collect()


def test_nothing_planned(spark):
    frame = pairs(spark)
    planned, key = by_order(frame.where("false"), False)
    assert micro_batch_texts(planned, frame, key, variant_texts([JOINT, SPLIT], False)).count() == 0


@pytest.mark.parametrize("limit", [None, 30])
def test_one_pass_equals_variant_by_variant(spark, limit):
    frame = pairs(spark, 40)
    once = tokens_of(letters())
    singly = Tokens(once.cut, once.count)
    templates = [JOINT, SPLIT, LOCALIZED]
    for system_role in (False, True):
        args = dict(max_length=limit, system_role=system_role)
        one, two = (
            flatten_samples(with_sample_lengths(frame, templates, tokens=t, **args)).select("row_id", "variant_no", "seq_len")
            for t in (once, singly)
        )
        assert one.count() == 40 * 6 and one.exceptAll(two).count() == two.exceptAll(one).count() == 0
        one, two = (
            sample_texts(frame, templates, tokens=t, **args).select("row_id", "variant_no", "input_text") for t in (once, singly)
        )
        assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_a_pair_without_prompt_has_no_text(spark):
    frame = pairs(spark, 1).withColumn("prompt", F.lit(None).cast("array<string>"))
    args = dict(max_length=9, tokens=tokens_of(letters()))
    assert [r.seq_len for r in flatten_samples(with_sample_lengths(frame, [JOINT, SPLIT], **args)).collect()] == [None] * 4
    assert [r.input_text for r in sample_texts(frame, [JOINT, SPLIT], **args).collect()] == [None] * 4


def test_a_row_passes_python_once(spark):
    frame = stage(pairs(spark, 5), "pairs")
    for made in (
        with_sample_lengths(frame, [JOINT, SPLIT], max_length=50, tokens=tokens_of(letters())),
        sample_texts(frame, [JOINT, SPLIT], max_length=50, tokens=tokens_of(letters())),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("EvalPython", plan)) == 1


def test_scorers_see_micro_batches(spark):
    """One micro batch at a time, within the budget, in row order; logits come back in source order."""
    frame = pairs(spark)
    planned, key = by_order(frame, False)
    batches = micro_batch_texts(planned, frame, key, variant_texts([JOINT, SPLIT], False))

    def scorer(samples: pd.DataFrame) -> np.ndarray:
        n, total = len(samples), int(samples["seq_len"].sum())
        if total > 400 and n > 1:
            raise ValueError("over the budget")
        lengths = samples["input_text"].str.len().to_numpy()
        return np.column_stack([lengths, np.arange(n), np.full(n, total)])

    logits = score_micro_batches(batches, scorer)
    assert logits.where("is_pad").count() == planned.where("is_pad").count() > 0
    back = restore_order(logits, 4).orderBy("batch_id", "position").collect()
    texts = {(r.row_id, r.variant_no): len(r.input_text) for r in sample_texts(frame, [JOINT, SPLIT], False).collect()}
    assert [(r.row_id, r.variant_no) for r in back] == [(f"{i:05d}", v) for i in range(97) for v in range(2)]
    assert all(r.logit_a == texts[r.row_id, r.variant_no] for r in back)
    sums = {}
    for r in planned.collect():
        sums.setdefault((r.batch_id, r.shard, r.micro_batch), []).append((r.row, r.seq_len))
    for r in logits.collect():
        own = sums[r.batch_id, r.shard, r.micro_batch]
        assert r.logit_tie == sum(n for _, n in own) and r.logit_b == sum(row < r.row for row, _ in own)
