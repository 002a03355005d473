"""Probabilities, losses, ensembles, scorers and the fitted model."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright.functions.labels import (
    FLOAT32_EPSILON,
    label_index,
    log_softmax,
    row_cross_entropy,
    row_log_loss,
    softmax,
)
from pairwright.operators.ensemble import attach_predictions, concat_sources, ensemble_mean
from pairwright.operators.fitting import FitSettings, fit_preference, gradient_norms, predict_preference
from pairwright.operators.losses import log_loss, micro_batch_loss, rolling_loss, weighted_loss
from pairwright.operators.scoring import MadeOnce, score, tokenize_with
from pairwright.plans.labelling import LENGTH_INPUTS, length_scorer, pseudo_label, with_lengths
from pairwright.schemas import LABEL_COLUMNS, PROBABILITY_COLUMNS

def xyz():
    return [F.col(c) for c in "xyz"]


def test_softmax_stands_big_logits(spark):
    table = spark.createDataFrame([(1000.0, 999.0, -1000.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    rows = table.select(*[p.alias(n) for p, n in zip(softmax(xyz()), "abc")]).collect()
    assert all(abs(sum(r) - 1) < 1e-12 for r in rows)
    assert rows[0].a == pytest.approx(1 / (1 + math.exp(-1)))
    logs = table.select(*[p.alias(n) for p, n in zip(log_softmax(xyz()), "abc")]).first()
    assert logs.c == pytest.approx(-2000 - math.log(1 + math.exp(-1)))


def test_label_index_takes_the_first_of_equals(spark):
    rows = [(0.4, 0.4, 0.2, 0), (0.2, 0.4, 0.4, 1), (0.0, 0.0, 1.0, 2)]
    table = spark.createDataFrame(rows, "x double, y double, z double, n int")
    assert table.where(label_index(xyz()) != F.col("n")).count() == 0


def test_log_loss_clips(spark):
    table = spark.createDataFrame([(1.0, 0.0, 0.0)], "x double, y double, z double")
    worst = table.select(row_log_loss(xyz(), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])).first()[0]
    assert worst == pytest.approx(-math.log(FLOAT32_EPSILON))
    assert log_loss(table, xyz(), [F.lit(0.5), F.lit(0.25), F.lit(0.25)]).first().log_loss == (
        pytest.approx(math.log(2))
    )


def test_weighted_loss_is_the_plain_mean(spark):
    table = spark.range(100).select(
        F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"),
        F.floor(F.sqrt("id")).alias("batch"),
    )
    soft = [F.lit(0.2), F.lit(0.3), F.lit(0.5)]
    batches = micro_batch_loss(table, soft, xyz(), ["batch"])
    plain = table.agg(F.avg(row_cross_entropy(soft, xyz()))).first()[0]
    assert weighted_loss(batches).first().loss == pytest.approx(plain)


@pytest.mark.parametrize("window,every,piece", [(20, 1, 64), (20, 10, 19), (1, 3, 5), (100, 7, 99)])
def test_rolling_loss_across_pieces(spark, window, every, piece):
    lengths = {0: 700, 1: 3, 2: 150}
    rows = [(run, s + 1, float((s * 37 + run) % 101)) for run, n in lengths.items() for s in range(n)]
    table = spark.createDataFrame(rows, "run_id int, step long, loss double")
    found = {(r.run_id, r.step): r.mean_loss for r in rolling_loss(table, window, every, piece).collect()}
    expected = {}
    for run in lengths:
        losses = [loss for r, _, loss in rows if r == run]
        for step in range(1, len(losses) + 1):
            if step % every == 0:
                last = losses[max(0, step - window) : step]
                expected[run, step] = sum(last) / len(last)
    assert found == pytest.approx(expected)


PREDICTION = "row_id int, scorer string, p_a double, p_b double, p_tie double"


def test_ensemble_mean_wants_every_scorer_once(spark):
    whole = [(i, s, 0.5, 0.25, 0.25) for i in range(3) for s in ("u", "v")]
    assert ensemble_mean(spark.createDataFrame(whole, PREDICTION), ["u", "v"]).count() == 3
    strange = whole[:-1] + [(2, "w", 0.5, 0.25, 0.25)]
    for broken in (whole[:-1], whole + whole[:1], strange):
        with pytest.raises(Exception, match="without just its scorers"):
            ensemble_mean(spark.createDataFrame(broken, PREDICTION), ["u", "v"]).collect()


def test_attaching_wants_the_same_rows(spark):
    pairs = spark.range(3).select(
        F.col("id").cast("int").alias("row_id"), *[F.lit(0.0).alias(c) for c in LABEL_COLUMNS]
    )
    means = spark.range(3).select(
        F.col("id").cast("int").alias("row_id"), *[F.lit(1 / 3).alias(c) for c in PROBABILITY_COLUMNS]
    )
    assert attach_predictions(pairs, means).where("winner_tie > 0.3").count() == 3
    for left, right in ((pairs.where("row_id > 0"), means), (pairs, means.where("row_id > 0"))):
        with pytest.raises(Exception, match="pairs and predictions differ at row 0"):
            attach_predictions(left, right).collect()


def test_sources_keep_apart(spark):
    one = spark.range(3).select(F.col("id").alias("row_id"), F.lit("x").alias("v"))
    both = concat_sources(one, one)
    assert both.select("row_id").distinct().count() == 6
    assert {r.source_no for r in both.collect()} == {0, 1}


def test_score_keeps_keys_and_sums_to_one(spark):
    table = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") / 100).alias("v"))

    def scorer(frame: pd.DataFrame) -> np.ndarray:
        v = frame["v"].to_numpy()
        return np.stack([v, -v, np.zeros_like(v)], axis=1)

    rows = {r.row_id: r for r in score(table, {"mine": MadeOnce("mine", lambda: scorer)}, ["v"]).collect()}
    assert len(rows) == 500
    for i, row in rows.items():
        assert row.scorer == "mine"
        assert row.p_a + row.p_b + row.p_tie == pytest.approx(1)
        assert math.log(row.p_a / row.p_b) == pytest.approx(2 * i / 100)


def test_tokenizer_hook(spark):
    def tokenizer(texts):
        return texts.str[:3], texts.str.len()

    row = spark.createDataFrame([("abcdef",)], "t string").select(
        tokenize_with(tokenizer)(F.col("t")).alias("m")
    ).first()
    assert (row.m.text, row.m.n_tokens) == ("abc", 6)


def judged(spark, rows=600):
    """Answers with the word `good` win; without it on either side it is a tie."""
    good = F.concat(F.lit("some words and good ones "), F.col("id"))
    poor = F.concat(F.lit("other words that are weak "), F.col("id"))
    kind = F.col("id") % 3
    return spark.range(rows).select(
        F.col("id").alias("row_id"),
        F.array(F.when(kind == 0, good).otherwise(poor)).alias("response_a"),
        F.array(F.when(kind == 1, good).otherwise(poor)).alias("response_b"),
        *[(kind == i).cast("double").alias(c) for i, c in enumerate(LABEL_COLUMNS)],
    )


@pytest.mark.parametrize("softness", [0.0, 0.3])
def test_fitted_model_beats_the_class_prior(spark, softness):
    table = judged(spark)
    soft = table.withColumns(
        {c: F.col(c) * (1 - softness) + softness / 3 for c in LABEL_COLUMNS}
    )
    model = fit_preference(soft.where("row_id < 450"))
    held_out = table.where("row_id >= 450")
    scored = predict_preference(model, held_out, "words").join(held_out, "row_id")
    loss = log_loss(
        scored, [F.col(c) for c in LABEL_COLUMNS], [F.col(c) for c in PROBABILITY_COLUMNS]
    ).first()
    assert loss.n == 150
    assert loss.log_loss < 0.7 * math.log(3)


def test_slopes_tell_whether_a_fit_ended(spark):
    table = judged(spark).withColumns({c: F.col(c) * 0.7 + 0.1 for c in LABEL_COLUMNS}).cache()
    parts = {"words_a", "words_b", "size_a", "size_b", "intercepts"}
    ended = {r.part: r.worst for r in gradient_norms(fit_preference(table, FitSettings(features=64, steps=200)), table).collect()}
    assert set(ended) == parts and max(ended.values()) < 1e-4
    short = {r.part: r.worst for r in gradient_norms(fit_preference(table, FitSettings(features=64, steps=2)), table).collect()}
    assert max(short.values()) > 1e-3


def test_pseudo_labels_are_the_mean_of_scorers(spark):
    table = judged(spark, 30).withColumn("row_id", F.col("row_id").cast("string"))
    scorers = {"one": length_scorer(1.0, 0.0), "two": length_scorer(2.0, 0.5)}
    measured = with_lengths(table)
    labelled = pseudo_label(measured, scorers, LENGTH_INPUTS).collect()
    assert len(labelled) == 30
    for row in labelled:
        gap = math.log1p(row.tokens_a) - math.log1p(row.tokens_b)
        masses = []
        for weight, tie in ((1.0, 0.0), (2.0, 0.5)):
            powers = [math.exp(weight * gap), math.exp(-weight * gap), math.exp(tie)]
            masses.append([p / sum(powers) for p in powers])
        mean = [sum(x) / 2 for x in zip(*masses)]
        assert [row[c] for c in LABEL_COLUMNS] == pytest.approx(mean)
