"""Exact de-duplication over an extendible-hash index that lies in shared files.

The index has one slot per distinct 64-bit key of the normalised text. Its directory starts at a depth
(number of leading key bits) that the slot count asks for and doubles until no bucket holds more than
`bucket_slots` slots; a bucket keeps the depth at which it stopped being overfull. Copies of one text
share one slot, so a text that is a third of all rows makes no bucket overfull.

Slots with several rows are chains. The texts of their rows, and of few others that a filter lets through, are
dealt by the directory to the owners of the buckets, who chain them by key and compare them byte by byte: what
is equal there is a group of copies. A long chain is first reduced in pieces, so that an owner gets a few of its rows.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import SPACES, task_count, whole
from pairwright.operators.filters import may_be_among
from pairwright.staging import stage

BUCKET_SLOTS = 20_000
#: Doublings of the directory that are counted at a time.
DOUBLINGS = 4
#: No directory is deeper: keys are distinct, so far fewer bits part any `bucket_slots` of them.
MOST_DEPTH = 62
#: Pieces into which the rows of one chain are cut before their texts are compared.
CHAIN_PIECES = 64


def normalised(text: str) -> Column:
    """Every run of ASCII white space as one blank; null as empty."""
    return F.regexp_replace(whole(text), SPACES, " ")


def _leading(key: str, depth: int) -> Column:
    """The first `depth` bits of a key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(slots: DataFrame, bucket_slots: int = BUCKET_SLOTS, doublings: int = DOUBLINGS) -> tuple[DataFrame, int]:
    """Directory entries (`entry`, `depth`, `bucket`) at the last depth, and that depth.

    Starts where the mean bucket fits and doubles, `doublings` times at once, until no bucket is overfull. Directory
    entries whose bucket did not need the last doublings point to the same, shallower bucket. The table has
    about 2 ** doublings * 2 * slots / bucket_slots rows and stays a DataFrame.
    """
    first = max(0, (slots.count() // bucket_slots).bit_length())
    last = first
    while True:
        last = min(MOST_DEPTH, last + doublings)
        entries = stage(slots.groupBy(_leading("key", last).alias("entry")).agg(F.count("*").alias("held")), "directory")
        most = entries.agg(F.max("held").alias("most")).first()["most"] or 0
        if most <= bucket_slots or last == MOST_DEPTH:
            break
    # Each entry under the bucket it would have at every depth; it stops at the first one that holds few enough.
    levels = entries.select("entry", "held", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")).withColumn(
        "at", F.call_function("shiftrightunsigned", F.col("entry"), F.lit(last) - F.col("depth"))
    )
    fitting = levels.groupBy("depth", "at").agg(F.sum("held").alias("together")).where((F.col("together") <= bucket_slots) | (F.col("depth") == last))
    stopped = levels.join(fitting, ["depth", "at"]).groupBy("entry").agg(F.min("depth").alias("depth"))
    below = F.lit(last) - F.col("depth")
    bucket = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("entry"), below), below)
    return stopped.withColumn("bucket", bucket), last


def build_index(slots: DataFrame, bucket_slots: int = BUCKET_SLOTS) -> tuple[DataFrame, DataFrame, int]:
    """Write slots (`key`, `held_rows`) as index files dealt by key range; the reread index, its directory and depth."""
    entries, last = directory(slots, bucket_slots)
    entries = stage(entries, "directory")
    placed = slots.withColumn("entry", _leading("key", last)).join(entries, "entry")
    owners = placed.repartitionByRange(task_count(slots), "bucket", "key")
    return stage(owners.select("bucket", "depth", "key", "held_rows"), "hash-index"), entries, last


def _chained(texts: DataFrame, entries: DataFrame, last: int) -> DataFrame:
    """(key, sha, keep, size) of the texts (`doc_id`, `key`, `norm`) that several rows have, found by the bucket owners."""
    piece = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.lit(CHAIN_PIECES))
    dealt = texts.withColumns({"entry": _leading("key", last), "piece": piece}).join(entries.select("entry", "bucket"), "entry")
    # Grouped by the text itself: compared by its bytes. Each piece of a chain leaves a row per text.
    reduced = dealt.groupBy("bucket", "key", "norm", "piece").agg(F.min("doc_id").alias("keep"), F.count("*").alias("size"))
    return (
        reduced.repartition(task_count(texts), "bucket")
        .groupBy("bucket", "key", "norm")
        .agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
        .where("size > 1")
        .select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "size")
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_slots: int = BUCKET_SLOTS) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Equal texts are those identical after `normalised`; the smallest doc_id of them stays. Null text counts
    as empty, and empty texts are copies of each other. Rows that repeat a doc_id each count in `group_size`
    and carry the same `kept`. A null doc_id is never smaller than another; a group of nulls only has a null
    `keep_id` and is kept. Other columns of `docs` are ignored; an empty table gives an empty result.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("body"))
    norm = normalised("body")
    read = given.select("doc_id", norm.alias("norm")).select("doc_id", F.xxhash64("norm").alias("key"), "norm")
    rows = stage(read.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "hash-rows")
    slots = stage(rows.groupBy("key").agg(F.count("*").alias("held_rows")), "hash-slots")
    index, entries, last = build_index(slots, bucket_slots)
    # By a merge at every size: the work then grows as the rows do.
    chained = stage(rows.join(index.where("held_rows > 1").select("key").hint("merge"), "key", "left_semi").select("doc_id"), "chained")
    # Most other texts stay where they are; those that pass are alone in their bucket.
    found = given.where(may_be_among(chained, "doc_id")).select("doc_id", norm.alias("norm"))
    texts = _chained(found.select("doc_id", F.xxhash64("norm").alias("key"), "norm"), entries, last)
    return rows.join(texts.hint("merge"), ["key", "sha"], "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.when(F.col("size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
