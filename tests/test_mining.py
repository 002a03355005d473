"""Pair mining against brute force, with hot prompts and hot copies."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pairwright.functions.turns import turns_key
from pairwright.operators import mining

CANDIDATE = "row_id long, model string, prompt array<string>, response array<string>"
SEED = 42


def brute_force(rows):
    """{(row_a, row_b)}: a plain walk over the rows of each prompt."""
    seen, kept = set(), []
    for row in sorted(rows):
        text = (tuple(row[2]), tuple(row[3]))
        if text not in seen:
            seen.add(text)
            kept.append(row)
    kept.sort(key=lambda row: hashlib.md5(f"{SEED}:{row[0]}".encode()).hexdigest())
    prompts = {}
    for row in kept:
        prompts.setdefault(tuple(row[2]), {}).setdefault(row[1], row)
    pairs = set()
    for models in prompts.values():
        firsts = list(models.values())
        for a, b in zip(firsts[::2], firsts[1::2]):
            pairs.add((a[0], b[0]))
    return pairs


def hot_rows_table():
    """One prompt with a third of the rows, one text with many copies, ordinary prompts."""
    rows = []
    for i in range(400):
        rows.append((i, f"m{i % 37}", ["hot"], [f"answer {i}"]))
    for i in range(400, 700):
        rows.append((i, f"m{i % 11}", ["copied"], ["same words"]))
    for i in range(700, 1200):
        rows.append((i, f"m{i % 7}", [f"p{i % 90}", "then"], [f"x{i % 13}", "y"]))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(hot_rows_table(), CANDIDATE).repartition(6)


def test_pairs_are_those_of_brute_force(table):
    plan = mining.pair_plan(mining.candidate_keys(table), SEED)
    found = [(r.row_a, r.row_b) for r in plan.select("row_a", "row_b").collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_force(hot_rows_table())


def test_each_model_is_in_one_pair_per_prompt_and_ids_are_unique(table):
    pairs = mining.mine_pairs(table, SEED)
    sides = pairs.select("prompt", "id", F.explode(F.array("model_a", "model_b")).alias("model"))
    counts = sides.groupBy("prompt", "model").count()
    assert counts.where("count > 1").count() == 0
    assert pairs.select("id").distinct().count() == pairs.count()
    assert pairs.where("model_a = model_b or response_a = response_b").count() == 0


def test_three_models_give_one_pair_and_one_left_over(spark):
    rows = [(i, f"m{i}", ["q"], [f"a{i}"]) for i in range(3)]
    assert mining.mine_pairs(spark.createDataFrame(rows, CANDIDATE)).count() == 1


def test_same_answer_from_two_models_gives_no_pair(spark):
    rows = [(1, "m1", ["q"], ["a"]), (2, "m2", ["q"], ["a"])]
    assert mining.mine_pairs(spark.createDataFrame(rows, CANDIDATE)).count() == 0


def test_turn_counts_must_agree(spark):
    rows = [(1, "m1", ["q"], ["a", "b"]), (2, "m2", ["q"], ["c"])]
    with pytest.raises(Exception, match="do not belong together"):
        mining.mine_pairs(spark.createDataFrame(rows, CANDIDATE)).collect()


def test_list_borders_count_in_keys(spark):
    rows = [(1, "m", ["a,b"], ["r"]), (2, "m", ["a", "b"], ["r"]), (3, "m", ["a", "b"], ["r"])]
    kept = mining.dedup_first(spark.createDataFrame(rows, CANDIDATE))
    assert sorted(r.row_id for r in kept.collect()) == [1, 2]


def test_dedup_keeps_the_first_row_and_its_model(table):
    kept = {r.row_id: r.model for r in mining.dedup_first(table).collect()}
    first = {}
    for row in sorted(hot_rows_table()):
        first.setdefault((tuple(row[2]), tuple(row[3])), (row[0], row[1]))
    assert kept == dict(first.values())


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_prompt_counts_with_and_without_spreading(table, hot_rows):
    counted = mining.attach_prompt_counts(mining.candidate_keys(table), hot_rows)
    found = {r.row_id: r.n_pid for r in counted.collect()}
    sizes = {}
    for row in hot_rows_table():
        sizes[tuple(row[2])] = sizes.get(tuple(row[2]), 0) + 1
    assert found == {row[0]: sizes[tuple(row[2])] for row in hot_rows_table()}


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_exclusion_with_and_without_spreading(spark, table, hot_rows):
    plan = mining.pair_plan(mining.candidate_keys(table), SEED)
    known = spark.createDataFrame([(["hot"],), (["hot"],), (["p3", "then"],)], "p array<string>")
    keys = known.select(turns_key(F.col("p")).alias("prompt_key"))
    left = mining.exclude_prompts(plan, keys, hot_rows)
    gone = {hashlib.sha256(json.dumps(p, separators=(",", ":")).encode()).hexdigest()
            for p in (["hot"], ["p3", "then"])}
    ids = {r.id for r in plan.collect()}
    assert {r.id for r in left.collect()} == {i for i in ids if i.split("_")[0] not in gone}
    assert mining.prompt_overlap(plan, keys).count() == 2


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_result_does_not_depend_on_partitions(spark, table, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = mining.mine_pairs(table.repartition(partitions), SEED)
        rows = {(r.id, r.row_a, r.row_b) for r in found.collect()}
        assert {(a, b) for _, a, b in rows} == brute_force(hot_rows_table())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
