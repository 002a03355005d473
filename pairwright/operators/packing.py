"""Batch plans: which sample goes to which batch, shard and micro batch.

A batch is bounded by its row count times the variants of a row, so work per
batch stays in one task while the number of batches grows with the data. After
the first shuffle by `batch_id` every step here reuses that partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.text import bind
from pairwright.operators.ranks import global_rank, ordered_rank
from pairwright.schemas import TURN_COLUMNS

# Ranges of batches that texts are sent to: the driver sees the first key of each, a megabyte or two at most.
HOMES = 1 << 14


def seeded_batches(
    rows: DataFrame, batch_size: int, seed: int, drop_last: bool = True, row_id: str = "row_id"
) -> DataFrame:
    """Training order: batches of consecutive rows of the seeded permutation."""
    ranked = global_rank(rows, seed, row_id, rank="rank", size="_total")
    batched = ranked.withColumn("batch_id", F.floor(F.col("rank") / batch_size))
    if drop_last:
        batched = batched.where(F.col("batch_id") < F.floor(F.col("_total") / batch_size))
    return batched.drop("_total")


def ordered_batches(
    rows: DataFrame, batch_size: int, order: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Evaluation order: batches of consecutive rows by `order`, none dropped."""
    ranked = ordered_rank(rows, [], order, rank="rank")
    return ranked.withColumn("rank", F.col("rank") - 1).withColumn(
        "batch_id", F.floor(F.col("rank") / batch_size)
    )


def order_in_batch(samples: DataFrame, by_length: bool = True) -> DataFrame:
    """`position` in the batch: by length in training, by source order otherwise.

    Equal lengths keep their source order. `batch_samples` is the batch's count.
    """
    batch = Window.partitionBy("batch_id")
    order = ["seq_len", "rank", "variant_no"] if by_length else ["rank", "variant_no"]
    return samples.withColumns(
        {
            "position": (F.row_number().over(batch.orderBy(*order)) - 1).cast("int"),
            "batch_samples": F.count("*").over(batch),
        }
    )


def pad_to_shards(samples: DataFrame, shards: int) -> DataFrame:
    """Repeat a batch's last sample up to a multiple of `shards`; `is_pad` marks copies."""
    missing = F.pmod(-F.col("batch_samples"), F.lit(shards)).cast("int")
    last = F.col("position") == F.col("batch_samples") - 1
    copies = F.sequence(F.lit(0), F.when(last, missing).otherwise(0))
    return (
        samples.withColumn("_copy", F.explode(copies))
        .withColumns(
            {
                "position": (F.col("position") + F.col("_copy")).cast("int"),
                "is_pad": F.col("_copy") > 0,
            }
        )
        .drop("_copy", "batch_samples")
    )


def assign_shards(samples: DataFrame, shards: int) -> DataFrame:
    """Position p goes to row p div shards, shard p mod shards."""
    return samples.withColumns(
        {
            "row": F.floor(F.col("position") / shards).cast("int"),
            "shard": F.pmod("position", F.lit(shards)).cast("int"),
        }
    )


def _segment_starts(lengths: Column, shards: int, max_tokens: int) -> Column:
    """First row of every micro batch but the first.

    Goes down the rows with the running sum of each shard; a row that takes any
    shard past the budget starts a new segment, unless the segment is empty.
    """
    nothing = F.array(*[F.lit(0).cast("long")] * shards)
    start = F.struct(
        nothing.alias("sums"),
        F.lit(0).alias("held"),
        F.lit(0).alias("row"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(state: Column, position: Column) -> Column:
        own = F.slice(lengths, position * shards + 1, F.lit(shards))
        sums = F.zip_with(state["sums"], own, lambda x, y: x + y)
        over = F.exists(sums, lambda total: total > max_tokens) & (state["held"] > 0)
        return F.struct(
            F.when(over, own).otherwise(sums).alias("sums"),
            F.when(over, 1).otherwise(state["held"] + 1).alias("held"),
            (state["row"] + 1).alias("row"),
            F.when(over, F.array_append(state["starts"], state["row"]))
            .otherwise(state["starts"])
            .alias("starts"),
        )

    rows = F.sequence(F.lit(0), F.floor(F.size(lengths) / shards).cast("int") - 1)
    return F.aggregate(rows, start, step, lambda state: state["starts"])


def segment_by_budget(samples: DataFrame, shards: int, max_tokens: int) -> DataFrame:
    """Add `micro_batch`: rows of a batch cut so that no shard passes `max_tokens`.

    A row that is over the budget by itself gets a segment of its own.
    """
    rest = [c for c in samples.columns if c not in ("batch_id", "position")]
    gathered = samples.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("position", *rest))).alias("_samples")
    )
    lengths = F.transform("_samples", lambda one: one["seq_len"].cast("long"))
    cut = gathered.withColumn("_lengths", lengths).withColumn(
        "_starts", _segment_starts(F.col("_lengths"), shards, max_tokens)
    )
    spread = cut.select("batch_id", "_starts", F.inline("_samples"))
    before = F.size(F.filter("_starts", lambda first: first <= F.col("row")))
    return spread.withColumn("micro_batch", before).drop("_starts")


def prefix_sums(lengths: Column) -> Column:
    """Running sums with a leading 0."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(
        lengths, zero, lambda sums, one: F.array_append(sums, F.element_at(sums, -1) + one)
    )


def position_ids(lengths: Column) -> Column:
    """0 .. length - 1 of every sample, one after the other."""
    return F.flatten(
        F.transform(
            lengths,
            lambda one: F.when(one > 0, F.sequence(F.lit(0), (one - 1).cast("int"))).otherwise(
                F.array().cast("array<int>")
            ),
        )
    )


def collate_varlen(samples: DataFrame) -> DataFrame:
    """One row per (batch, shard, micro batch): lists in row order, offsets, stacked labels."""
    item = F.struct("row", "row_id", "variant_no", "seq_len", "label", "is_pad")
    grouped = samples.groupBy("batch_id", "shard", "micro_batch").agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    )
    lengths = F.transform("_items", lambda one: one["seq_len"])
    return grouped.select(
        "batch_id",
        "shard",
        "micro_batch",
        F.size("_items").alias("batch_size"),
        F.transform("_items", lambda one: one["row_id"]).alias("row_ids"),
        lengths.alias("seq_lens"),
        prefix_sums(lengths).alias("cu_seqlens"),
        F.array_max(lengths).alias("max_seq_len"),
        F.transform("_items", lambda one: one["label"]).alias("labels"),
    )


def _homes(firsts: DataFrame, key: Column) -> Column:
    """How many of the `first` keys (HOMES rows at most) lie at or before the key, less one.

    They become one literal of the plan. The key is held against every so-many-th of them, then against those
    that follow it, both as hex digits, which have the order of the texts.
    """
    borders = sorted(row["first"] for row in firsts.select(F.hex("first").alias("first")).collect())
    if not borders:
        return F.lit(-1)
    width = max(1, math.isqrt(len(borders)))
    digits = F.hex(key)

    def passed(ascending: Column) -> Column:
        return F.size(F.filter(ascending, lambda one: one <= digits))

    row = passed(F.split(F.lit(",".join(borders[::width])), ",")) - 1
    beside = F.slice(F.split(F.lit(",".join(borders)), ","), F.greatest(row, F.lit(0)) * width + 1, F.lit(width))
    return bind(row, lambda at: F.when(at < 0, -1).otherwise(at * width + passed(beside) - 1))


def micro_batch_texts(planned: DataFrame, pairs: DataFrame, key: Column, texts: Column) -> DataFrame:
    """(batch_id, shard, micro_batch, samples): what a worker reads, with the texts of its samples in row order.

    `planned` is a written plan, `pairs` are its source rows, `texts` makes a pair's texts by `variant_no`. Batches
    are runs of rows in the order of the text `key`, which both tables have the columns for. So a pair can be sent to where its
    batch is put together by the first keys of some batches: it is moved once, as it is, and rendered there. Ends
    the job when the plan has a row that `pairs` lack; rows without a batch are left out.
    """
    last = planned.agg(F.max("batch_id").alias("last")).first()["last"]
    per_home = (last or 0) // HOMES + 1
    firsts = planned.where(F.col("batch_id") % per_home == 0).groupBy("batch_id").agg(F.min(key).alias("first"))
    place = F.struct("batch_id", "shard", "micro_batch", "row", "variant_no", "is_pad", "seq_len", "label")
    pair = F.struct(*TURN_COLUMNS)
    placed = planned.select(F.floor(F.col("batch_id") / per_home).cast("int").alias("home"), "row_id", place.alias("place"))
    sent = pairs.select(_homes(firsts, key).cast("int").alias("home"), "row_id", pair.alias("pair"))
    # One exchange by home; what follows groups by it and more, so nothing is moved again.
    met = placed.unionByName(sent, allowMissingColumns=True).repartition("home")
    rows = (
        met.groupBy("home", "row_id")
        .agg(F.any_value("pair", F.lit(True)).alias("pair"), F.collect_list("place").alias("places"))
        .where(F.size("places") > 0)
    )
    stop = F.raise_error(F.concat(F.lit("planned row without a pair: "), F.col("row_id").cast("string")))
    sound = F.when(F.col("pair").isNull(), stop.cast(rows.schema["pair"].dataType)).otherwise(F.col("pair"))
    rendered = rows.withColumn("pair", sound).select("home", "row_id", "places", "pair.*").select(
        "home", "row_id", texts.alias("texts"), F.inline("places")
    )
    item = F.struct(
        "row", "row_id", "variant_no", "is_pad", "seq_len", "label", F.get("texts", F.col("variant_no")).alias("input_text")
    )
    return (
        rendered.select("home", "batch_id", "shard", "micro_batch", item.alias("item"))
        .groupBy("home", "batch_id", "shard", "micro_batch")
        .agg(F.array_sort(F.collect_list("item")).alias("samples"))
        .drop("home")
    )


def batch_totals(collated: DataFrame) -> DataFrame:
    """Samples per batch over its micro batches."""
    return collated.groupBy("batch_id").agg(F.sum("batch_size").alias("total_batch_size"))


def restore_order(samples: DataFrame, shards: int) -> DataFrame:
    """Shards interleaved back to batch positions, padding dropped."""
    return samples.where(~F.col("is_pad")).withColumn(
        "position", F.col("row") * shards + F.col("shard")
    )


def plan_batches(
    batched: DataFrame, shards: int, max_tokens: int, by_length: bool = True
) -> DataFrame:
    """Flattened, batched samples to their micro batches."""
    padded = pad_to_shards(order_in_batch(batched, by_length), shards)
    return segment_by_budget(assign_shards(padded, shards), shards, max_tokens)
