"""What the physical plans must look like before any data is seen."""

import re

import pytest
from pyspark.sql import functions as F

from checks import views
from checks.queries import QUERIES
from pairwright.operators.folds import group_folds, prompt_groups
from pairwright.operators.keys import with_row_key
from pairwright.operators.mining import candidate_keys, dedup_first, pair_plan
from pairwright.operators.scoring import score
from pairwright.plans.labelling import LENGTH_INPUTS, pseudo_label
from pairwright.schemas import LABEL_COLUMNS
from pairwright.staging import stage


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pair_mining", "prompt_frequency", "exclude_known_prompts",
                                  "attach_soft_labels", "rolling_loss", "batch_plan"])
def test_no_cross_joins(spark, sf_dir, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", planned(QUERIES[name](spark, sf_dir)))


def test_scans_read_only_what_they_need(spark, sf_dir):
    assert "ReadSchema: struct<conv_id:bigint,role:string,text:string>" in planned(
        QUERIES["chat_validation"](spark, sf_dir)
    )
    assert "ReadSchema: struct<doc_id:bigint>" in planned(QUERIES["shuffle_rank"](spark, sf_dir))
    sources = planned(QUERIES["concat_sources"](spark, sf_dir))
    assert "EqualTo(lang,en)" in sources and "text:string" not in sources


def test_pair_planning_shuffles_no_texts(spark, sf_dir):
    plan = planned(pair_plan(candidate_keys(views.candidates(spark, sf_dir))))
    text = re.search(r"FileScan parquet \[[^\]]*?(text#\d+)", plan).group(1)
    shuffled = [line for line in plan.splitlines() if "Exchange" in line or "SortAggregate" in line]
    assert shuffled and not any(text in line for line in shuffled)


def test_narrow_operators_do_not_shuffle(spark, sf_dir):
    for name in ("truncate_text", "token_length", "softmax_probs"):
        assert "Exchange" not in planned(QUERIES[name](spark, sf_dir))


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges_over(plan, column):
    """Exchanges that carry `column`, of a printed plan: those below which a scan reads it, without a filter between."""
    lines = plan.splitlines()
    moved = []
    for i, line in enumerate(lines):
        if "Exchange" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        for below in lines[i + 1 :]:
            own = len(below) - len(below.lstrip(" :+-*()0123456789"))
            if own <= depth:
                break
            if "Filter" in below and "Subquery subquery" in below:
                break
            if "FileScan" in below and column in below:
                moved.append(line)
                break
    return moved


def test_dedup_leaves_texts_in_place(spark, sf_dir, no_broadcasts):
    """No exchange has texts below it but behind the filter of later copies; no text is sorted or hashed to a join."""
    plan = planned(dedup_first(stage(views.candidates(spark, sf_dir).drop("lang"), "rows")))
    assert "Subquery subquery" in plan and "Union" in plan
    assert exchanges_over(plan, "response:array") == []
    assert [line for line in plan.splitlines() if "Exchange" in line]


def test_a_text_on_a_third_of_rows_is_deduplicated(spark):
    rows = spark.range(3000).select(
        F.format_string("%05d", "id").alias("row_id"),
        (F.col("id") % 5).cast("string").alias("model"),
        F.array(F.lit("p")).alias("prompt"),
        F.array(F.when(F.col("id") % 3 == 0, "copied").otherwise(F.col("id").cast("string"))).alias("response"),
    )
    kept = dedup_first(rows, hot_rows=100)
    assert kept.count() == 2001
    assert [r.row_id for r in kept.where("response[0] = 'copied'").collect()] == ["00000"]
    assert dedup_first(rows.where("false")).count() == 0


def test_keys_leave_texts_in_place(spark, sf_dir, no_broadcasts):
    frame = stage(views.corpus(spark, sf_dir).drop("row_id"), "corpus")
    plan = planned(with_row_key(frame))
    assert not re.search(r" Sort |SortAggregate|Window", plan)
    assert exchanges_over(plan, "chosen:array") == []


def test_texts_are_filtered_before_they_move(spark, sf_dir, no_broadcasts):
    plan = planned(views.judged_pairs(spark, sf_dir))
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert exchanges_over(plan, "text:string") == [] and "text:string" in plan


def test_scoring_is_one_scan_without_a_shuffle(spark):
    pairs = spark.range(9).selectExpr("id AS row_id", "1 AS tokens_a", "2 AS tokens_b", *[f"0D AS {c}" for c in LABEL_COLUMNS])
    plan = planned(pseudo_label(pairs, views.SCORERS, LENGTH_INPUTS))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    scored = planned(score(pairs, views.SCORERS, LENGTH_INPUTS))
    assert "Exchange" not in scored and scored.count("Range (0") == 1


def test_folds_need_no_single_task(spark, sf_dir):
    groups = stage(prompt_groups(views.judged_plan(spark, sf_dir)), "groups")
    plan = planned(group_folds(groups, 5, 0))
    # The one window over everything holds a row per range of sizes; strata are joined by piece.
    assert not re.search(r"SortMergeJoin \[n_a#\d+L?, n_b#\d+L?, n_tie#\d+L?\]", plan)
