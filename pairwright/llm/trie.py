"""The prefix trie of conversations, by truncation peeling.

A node is a distinct sequence of first turns; conversations that start with it are its members. Equal
conversations are one class; a class is a path of prefix digests. Inside a group of classes the trie is peeled
from its deepest level: nodes that end there meet the ones that survived from below, every one is finished,
stripped of its last turn and handed to its parent, which is found by its own digest. So a node is made and
summed up in the same step, and no node is listed under its ancestors.

Groups are bounded: a prefix that more than GROUP_ROWS classes share is *hot*, and a group is what lies under
the first prefix of a path that is not. What a group leaves over is merged into the hot node above it, before
the shuffle as far as it goes; hot nodes are the classes of the next round, with their paths cut there. Rounds end
when one group holds the rest, root and all. No task has a hot prefix's rows together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import task_count
from pairwright.staging import stage

#: Rows under a prefix that a task may have together; more make it hot.
GROUP_ROWS = 4096
#: Pieces that a prefix's rows are dealt to where they meet the list of hot ones: that list grows so many times, to
#: PIECES / GROUP_ROWS of the prefixes at most.
PIECES = 256
#: Conversation ids whose list of ends is one piece of text.
SPAN = 4096
#: The node without turns, and what no conversations that end at a node hash to.
ROOT = b""
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What is known of a finished node.
NODE = ("node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")


def nested(turns: DataFrame, turn: str = "turn") -> DataFrame:
    """(conv_id, turns): per conversation a list of (digest, length) in order, for texts that stay where they are."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    # The length of the role keeps it apart from the text.
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, text), 256)), 1, 16)
    item = F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("length"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), item.alias("item"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return listed.select("conv_id", F.transform("items", _bare).alias("turns"))


def _bare(item: Column) -> Column:
    return F.struct(item["digest"].alias("digest"), item["length"].alias("length"))


def _paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, lens): the digests of all prefixes of a conversation, longest last, and the turns' lengths."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                paths, lens = [], []
                for turns in part.column("turns").to_pylist():
                    path, last = [], ROOT
                    for one in turns:
                        last = hashlib.sha256(last + one["digest"]).digest()[:16]
                        path.append(last)
                    paths.append(path)
                    lens.append([one["length"] for one in turns])
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(paths, pa.list_(pa.binary())), pa.array(lens, pa.list_(pa.int64()))],
                    names=["conv_id", "path", "lens"],
                )

    return conversations.mapInArrow(chain, "conv_id long, path array<binary>, lens array<long>")


def _end() -> Column:
    return F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(bytearray(ROOT)))


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ascending, comma-joined ids of the conversations that end at a node.

    Ids come as pieces of text, a span of ids each; one task takes in a node's pieces one after the other,
    as the hash wants it, and holds a batch of them only.
    """
    pieces = (
        paths.select(_end().alias("node"), "conv_id", F.floor(F.col("conv_id") / SPAN).alias("span"))
        .groupBy("node", "span")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
        .repartition(task_count(paths), "node")
        .sortWithinPartitions("node", "span")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: list[tuple[bytes, str]] = []

        def given() -> pa.RecordBatch:
            nodes, ends = [one for one, _ in done], [one for _, one in done]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(ends, pa.string())], names=["node", "ends"])

        for batch in batches:
            for own, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
                if own == node:
                    state.update(b"," + piece.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(piece.encode())
            yield given()
            done.clear()
        if node is not None:
            done.append((node, state.hexdigest()))
        yield given()

    return pieces.mapInArrow(digest, "node binary, ends string")


def _peeled(rows: list[dict], done: dict[str, list]) -> list[tuple]:
    """Peel groups of rows from their deepest level up to each one's `upto`; finished nodes go to `done`.

    Returns what is left over: (path, lens, n, conv_id, ends, n_children, n_leaves, saved) of hot nodes.
    """
    levels: dict[int, dict[bytes, list]] = {}

    def met(depth: int, digest: bytes, row: dict, n: int, conv: int, ends: str | None, children: int, leaves: int, saved: int, below: list) -> None:
        at = levels.setdefault(depth, {})
        node = at.get(digest)
        if node is None:
            at[digest] = [row, n, conv, ends, children, leaves, saved, below]
            return
        node[1] += n
        node[2] = min(node[2], conv)
        node[3] = node[3] or ends
        node[4] += children
        node[5] += leaves
        node[6] += saved
        node[7] += below

    for row in rows:
        path = row["path"]
        # A class that ends above its group's first node goes on as it is.
        met(len(path), path[-1] if path else ROOT, row, row["n"], row["conv_id"], row["ends"], row["n_children"], row["n_leaves"], row["saved"], [])
    left = []
    while levels:
        depth = max(levels)
        for digest, (row, n, conv, ends, children, leaves, saved, below) in levels.pop(depth).items():
            if depth < row["upto"]:
                left.append((row["path"][:depth], row["lens"][:depth], n, conv, ends, children, leaves, saved))
                continue
            leaves = leaves or 1
            if depth:
                saved += (n - 1) * row["lens"][depth - 1]
            at = len(done["depth"])
            # The parent's smallest member is known when it is finished, or from the count of hot prefixes.
            for name, value in zip(done, (digest, depth, conv, row["above"] if depth == row["upto"] else None, n, children, leaves, saved, ends or NO_ENDS)):
                done[name].append(value)
            for child in below:
                done["parent_conv_id"][child] = conv
            if not depth:
                continue
            if depth == row["upto"]:
                left.append((row["path"][: depth - 1], row["lens"][: depth - 1], n, conv, None, 1, leaves, saved))
            else:
                met(depth - 1, row["path"][depth - 2] if depth > 1 else ROOT, row, n, conv, None, 1, leaves, saved, [at])
    return left


def _peel(grouped: DataFrame) -> DataFrame:
    """Nodes (with `depth`) and left-over rows (with `path`) of rows with `group`, `upto` and `above`, in one pass."""
    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def given() -> pa.RecordBatch:
            done: dict[str, list] = {name: [] for name in NODE}
            left = _peeled(held, done)
            none, many = [None] * len(left), len(done["depth"])
            columns = {
                "n_left": pa.array([True] * len(left) + [False] * many),
                "path": pa.array([one[0] for one in left] + [None] * many, pa.list_(pa.binary())),
                "lens": pa.array([one[1] for one in left] + [None] * many, pa.list_(pa.int64())),
                "n": pa.array([one[2] for one in left] + done["n_convs"], pa.int64()),
                "ends": pa.array([one[4] for one in left] + done["ends"], pa.string()),
                "n_children": pa.array([one[5] for one in left] + done["n_children"], pa.int64()),
                "n_leaves": pa.array([one[6] for one in left] + done["n_leaves"], pa.int64()),
                "saved": pa.array([one[7] for one in left] + done["saved"], pa.int64()),
                "node": pa.array(none + done["node"], pa.binary()),
                "depth": pa.array(none + done["depth"], pa.int32()),
                "conv_id": pa.array([one[3] for one in left] + done["conv_id"], pa.int64()),
                "parent_conv_id": pa.array(none + done["parent_conv_id"], pa.int64()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        last = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                for row in batch.slice(begin, 512).to_pylist():
                    # Whole groups only; small ones are peeled together.
                    if row["group"] != last and len(held) >= GROUP_ROWS:
                        yield given()
                        held.clear()
                    last = row["group"]
                    held.append(row)
        yield given()

    schema = (
        "n_left boolean, path array<binary>, lens array<long>, n long, ends string, n_children long, n_leaves long, saved long,"
        " node binary, depth int, conv_id long, parent_conv_id long"
    )
    return grouped.mapInArrow(peel, schema)


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with `group`, `upto` (the depth of the group's first node) and `above` (the smallest member of its parent).

    Hot prefixes of a path are its first ones, the root among them, so their number is the depth of the group.
    """
    prefixes = rows.select(
        F.col("conv_id").alias("row"), "conv_id", F.explode(F.concat(F.array(F.lit(bytearray(ROOT))), F.col("path"))).alias("node")
    )
    counted = prefixes.groupBy("node").agg(F.count("*").alias("rows"), F.min("conv_id").alias("least"))
    hot = stage(counted.where(F.col("rows") > GROUP_ROWS).select("node", "least"), "hot-prefixes")
    every = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))
    dealt = prefixes.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(PIECES)).cast("int"))
    # The shallower a prefix, the smaller its smallest member; the group hangs on the deepest hot one.
    found = (
        dealt.join(hot.withColumn("piece", every).hint("merge"), ["node", "piece"])
        .groupBy("row")
        .agg(F.count("*").cast("int").alias("upto"), F.max("least").alias("above"))
    )
    placed = rows.join(found.withColumnRenamed("row", "conv_id").hint("merge"), "conv_id", "left")
    upto = F.coalesce("upto", F.lit(0))
    # Row ends among hot prefixes: a group of its own, which is handed on as it is.
    group = F.when(upto == 0, F.lit(bytearray(ROOT))).otherwise(F.coalesce(F.get("path", upto - 1), _end()))
    return placed.withColumns({"group": group, "upto": upto})


def _merged(left: DataFrame) -> DataFrame:
    """Left-over rows that belong to one hot node, as one row; summed before they are moved."""
    return (
        left.withColumn("node", _end())
        .groupBy("node")
        .agg(
            F.any_value("path").alias("path"),
            F.any_value("lens").alias("lens"),
            F.sum("n").alias("n"),
            F.min("conv_id").alias("conv_id"),
            F.max("ends").alias("ends"),
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved").alias("saved"),
        )
        .drop("node")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per trie node: `node`, `depth`, `conv_id`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved`, `ends`.

    `conversations` are (conv_id, turns), as `nested` makes them, one row per conversation; an empty list is a
    conversation without turns, a member of the root. `node` is a digest of the turns, `conv_id` the smallest
    member, `parent_conv_id` that of the parent (null for the root), `n_leaves` the childless nodes of the subtree,
    `saved` the sum over the subtree of (members - 1) times the code points of the node's last text, `ends` the hash
    of the ids that end at the node. Without conversations there is no node.
    """
    paths = stage(_paths(conversations), "paths")
    classes = (
        paths.groupBy(_end().alias("node"))
        .agg(F.any_value("path").alias("path"), F.any_value("lens").alias("lens"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
        .join(_ends(paths).hint("merge"), "node")
        .drop("node")
    )
    zero = F.lit(0).cast("long")
    rows = stage(classes.withColumns({"n_children": zero, "n_leaves": zero, "saved": zero}), "classes")
    finished = []
    while True:
        grouped = stage(_grouped(rows), "groups")
        dealt = grouped.repartition(task_count(rows), "group").sortWithinPartitions("group")
        peeled = stage(_peel(dealt), "peeled")
        finished.append(
            peeled.where("NOT n_left").select(
                "node", "depth", "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved", "ends"
            )
        )
        left = peeled.where("n_left").drop("node", "depth", "parent_conv_id", "n_left")
        if left.isEmpty():
            break
        rows = stage(_merged(left), "classes")
    whole = finished[0]
    for one in finished[1:]:
        whole = whole.unionByName(one)
    return whole


def rebuilt(conversations: DataFrame, every: int = 100, turns: int = 6) -> DataFrame:
    """Conversations that take their first turns from the first one of their hundred, as many as their hash says.

    Conversation c has the first h turns of c - c % every and its own ones after its first h; h is the
    unsigned crc32 of the decimal c, modulo `turns`.
    """
    base = conversations.select(F.col("conv_id").alias("base"), F.col("turns").alias("before"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(turns)).cast("int")
    own = conversations.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h})
    none = F.slice("turns", F.lit(1), F.lit(0))
    first = F.slice(F.coalesce("before", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(base.hint("merge"), "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))
