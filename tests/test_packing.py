"""Batch plans against a plain walk over each batch."""

import pytest
from pyspark.sql import functions as F

from pairwright.operators.augment import flatten_samples, swap_augment, swap_sides
from pairwright.operators.packing import (
    assign_shards,
    batch_totals,
    collate_varlen,
    order_in_batch,
    ordered_batches,
    pad_to_shards,
    plan_batches,
    position_ids,
    prefix_sums,
    restore_order,
    seeded_batches,
)


def source_rows(spark, rows, variants=2, lengths=None):
    def length(variant):
        if lengths is not None:
            return F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("id").cast("int") + 1)
        return (F.pmod(F.xxhash64("id", F.lit(variant)), F.lit(900)) + 1).cast("int")

    samples = F.array(
        *[
            F.struct(
                F.lit(v).alias("variant_no"),
                F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("label"),
                length(v).alias("seq_len"),
            )
            for v in range(variants)
        ]
    )
    return spark.range(rows).select(F.col("id").alias("row_id"), samples.alias("samples"))


def walk(lengths, shards, budget):
    """Micro batch of every row of a batch, by hand."""
    rows = [lengths[i : i + shards] for i in range(0, len(lengths), shards)]
    found, number, sums, held = [], 0, [0] * shards, 0
    for row in rows:
        grown = [x + y for x, y in zip(sums, row)]
        if held and max(grown) > budget:
            number, grown, held = number + 1, list(row), 0
        sums, held = grown, held + 1
        found.append(number)
    return found


@pytest.mark.parametrize("shards,budget", [(1, 1500), (4, 2000), (3, 100), (8, 10**9)])
def test_plan_equals_the_walk(spark, shards, budget):
    batched = seeded_batches(source_rows(spark, 137), 20, seed=1)
    planned = plan_batches(flatten_samples(batched), shards, budget).collect()
    batches = {}
    for row in planned:
        batches.setdefault(row.batch_id, []).append(row)
    assert len(batches) == 6  # the seventeen rows left over are dropped
    for rows in batches.values():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        assert len(rows) % shards == 0
        lengths = [r.seq_len for r in rows]
        assert lengths == sorted(lengths)
        expected = walk(lengths, shards, budget)
        assert [r.micro_batch for r in rows] == [expected[r.row] for r in rows]
        assert all(r.row == r.position // shards and r.shard == r.position % shards for r in rows)
        own = [r for r in rows if not r.is_pad]
        assert len(own) == 40 and len({(r.row_id, r.variant_no) for r in own}) == 40
        for pad in rows[40:]:
            assert pad.is_pad and (pad.row_id, pad.variant_no) == (rows[39].row_id, rows[39].variant_no)
        spent = {}
        for r in rows:
            spent.setdefault((r.micro_batch, r.shard), []).append(r.seq_len)
        assert all(sum(x) <= budget or len(x) == 1 for x in spent.values())


def test_one_overlong_sample_gets_its_own_segment(spark):
    rows = source_rows(spark, 4, variants=1, lengths=[10, 10, 20_000, 20_001])
    batched = ordered_batches(rows, 4)
    planned = plan_batches(flatten_samples(batched), 1, 16_384, by_length=False)
    assert [r.micro_batch for r in planned.orderBy("position").collect()] == [0, 0, 1, 2]


def test_one_shard_over_the_budget_cuts_all(spark):
    rows = source_rows(spark, 4, variants=1, lengths=[10, 3, 1, 1])
    planned = plan_batches(flatten_samples(ordered_batches(rows, 4)), 2, 9, by_length=False)
    assert [r.micro_batch for r in planned.orderBy("position").collect()] == [0, 0, 1, 1]


def test_padding_and_back(spark):
    rows = source_rows(spark, 5, variants=1)
    samples = order_in_batch(flatten_samples(ordered_batches(rows, 5)), by_length=False)
    padded = assign_shards(pad_to_shards(samples, 4), 4)
    assert padded.where("is_pad").count() == 3
    back = restore_order(padded, 4).orderBy("position").collect()
    assert [r.row_id for r in back] == list(range(5))


def test_evaluation_keeps_order_and_every_row(spark):
    batched = ordered_batches(source_rows(spark, 101, variants=1), 10)
    planned = plan_batches(flatten_samples(batched), 4, 2000, by_length=False)
    back = restore_order(planned, 4).orderBy("batch_id", "position").collect()
    assert [r.row_id for r in back] == list(range(101))


def test_collated_lists(spark):
    batched = seeded_batches(source_rows(spark, 60), 15, seed=3)
    planned = plan_batches(flatten_samples(batched), 4, 1500)
    collated = collate_varlen(planned)
    for row in collated.collect():
        assert row.batch_size == len(row.seq_lens) == len(row.labels) == len(row.row_ids)
        running = [0]
        for one in row.seq_lens:
            running.append(running[-1] + one)
        assert row.cu_seqlens == running
        assert row.max_seq_len == max(row.seq_lens)
    assert {r.total_batch_size for r in batch_totals(collated).collect()} == {32}


def test_offsets_and_positions_of_edge_lengths(spark):
    table = spark.createDataFrame([([2, 0, 3],), ([],)], "l array<int>")
    rows = table.select(
        prefix_sums(F.col("l")).alias("s"), position_ids(F.col("l")).alias("p")
    ).collect()
    assert [r.s for r in rows] == [[0, 2, 2, 5], [0]]
    assert [r.p for r in rows] == [[0, 1, 0, 1, 2], []]


def test_swapping_twice_changes_nothing(spark):
    pair = spark.createDataFrame(
        [("x", "y", ["p"], ["a"], ["b"], 1.0, 0.0, 0.0)],
        "model_a string, model_b string, prompt array<string>, response_a array<string>,"
        "response_b array<string>, winner_model_a double, winner_model_b double, winner_tie double",
    )
    twice = swap_sides(swap_sides(pair, F.lit(True)), F.lit(True))
    assert twice.collect() == pair.collect()
    mirror = swap_augment(pair).where("swapped").first()
    assert (mirror.model_a, mirror.response_a, mirror.winner_model_b) == ("y", ["b"], 1.0)
    assert mirror.prompt == ["p"]
