"""Near-duplicates of embeddings: collisions in windows of many sorted one-dimensional projections.

Two unit vectors at the asked cosine differ by a normal variable of known width along a random direction, so they
fall into a window of WIDTH times that width around either one with a known chance, and the number of windows
they share is binomial. Vectors are sorted along PROJECTIONS directions, the window of each one is a range of the
sorted list, and a pair's collisions are counted: after the first FIRST directions pairs below a first count are
out, after all of them those below the second. Both counts are set from the binomial distribution, so that a
pair just at the cosine is lost with a chance of LOSS each; closer pairs are lost more rarely. What is left is verified.

A label may hold a third of all rows, so vectors meet in cells: the signs of a few directions of their own, less
the median, for several tables, until a pair at the cosine shares a cell but with a chance of MISSED. Cells
that hold more than CELL vectors all the same are cut into blocks, and every two blocks meet somewhere. A pair is
counted in the first cell that it shares only, so links are added up without naming the pairs. Equal vectors are
one item with a number of copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.components import components
from pairwright.llm.tables import hashed_sample, task_count
from pairwright.staging import stage

#: The cosine of a link.
ALIKE = 0.93
#: Directions whose windows are counted, those of the first count, and half a window in widths of a pair.
PROJECTIONS, FIRST, WIDTH = 40, 12, 1.5
#: Chance that either count loses a pair just at the cosine, and that no table puts it into one cell.
LOSS, MISSED = 5e-4, 2e-3
#: Vectors that meet in one block; items whose median along a direction is the border of cells; most signs of a cell.
CELL, SAMPLE, MOST_BITS = 1024, 4096, 30
#: Pairs that are looked at together.
AT_ONCE = 1 << 16


def directions(dim: int, kind: str, number: int) -> np.ndarray:
    """`number` random directions, the same in every task."""
    seed = int.from_bytes(hashlib.sha256(f"{kind}/{dim}".encode()).digest()[:8], "big")
    return np.random.default_rng(seed).standard_normal((number, dim))


def least_count(number: int, chance: float, loss: float) -> int:
    """The largest count that Binomial(number, chance) falls short of with a probability of `loss` at most."""
    below, count = 0.0, 0
    while count < number:
        below += math.comb(number, count) * chance**count * (1 - chance) ** (number - count)
        if below > loss:
            break
        count += 1
    return count


def table_plan(items: int, alike: float, cell: int = CELL) -> tuple[int, int]:
    """(signs per cell, tables) for so many items of one label."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, items) / cell))))
    if not bits:
        return 0, 1
    same = (1 - math.acos(alike) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - same))


def _unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one, in double precision; none if it has no direction."""
    if not vector or any(value is None for value in vector):
        return None
    v = np.asarray(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, item, unit): `item` names equal vectors of a label, null where a row links with nothing."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                items, units = [], []
                for vector, label in zip(part.column("embedding").to_pylist(), part.column("label").to_pylist()):
                    unit = None if label is None else _unit(vector)
                    if unit is None:
                        items.append(None)
                        units.append(None)
                        continue
                    # Adding zero makes -0.0 and 0.0 one.
                    own = (unit + 0.0).tobytes()
                    items.append(hashlib.sha256(f"{label}/".encode() + own).digest()[:16])
                    units.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(items, pa.binary()), pa.array(units, pa.binary())],
                    names=["vec_id", "label", "item", "unit"],
                )

    return vectors.mapInArrow(prepare, "vec_id long, label string, item binary, unit binary")


def _codes(units: np.ndarray, bits: int, tables: int, medians: dict[int, np.ndarray]) -> np.ndarray:
    """A cell number per row and table."""
    if not bits:
        return np.zeros((len(units), tables), np.int64)
    dim = units.shape[1]
    along = units @ directions(dim, "cells", bits * tables).T
    held = medians.get(dim, np.zeros(0))[: bits * tables]
    border = np.concatenate([held, np.zeros(bits * tables - len(held))])
    signs = (along > border).reshape(len(units), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _by_dim(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each dimension."""
    lengths = np.array([len(unit) for unit in units])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        yield places, np.stack([np.frombuffer(units[place], np.float64) for place in places])


def _medians(items: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Per dimension, the median along the directions of the cells, over a bounded sample."""
    units = [row["unit"] for row in hashed_sample(items, SAMPLE, "item").select("unit").limit(2 * SAMPLE).collect()]
    out = {}
    for _, rows in _by_dim([bytes(unit) for unit in units]) if units else ():
        out[rows.shape[1]] = np.median(rows @ directions(rows.shape[1], "cells", most).T, axis=0)
    return out


def collided(units: np.ndarray, alike: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (first below second) that share enough windows; `apart` numbers the blocks, and rows of one do not meet."""
    size = len(units)
    width = WIDTH * math.sqrt(2 - 2 * alike)
    chance = math.erf(WIDTH / math.sqrt(2))
    along = units @ directions(units.shape[1], "windows", PROJECTIONS).T
    counts = np.zeros(size * size, np.uint8)
    for t in range(FIRST):
        order = np.argsort(along[:, t], kind="stable")
        line = along[order, t]
        # The window of each vector, to the right of it in the sorted list; the left half is the other one's.
        ends = np.searchsorted(line, line + width, "right")
        reach = ends - np.arange(1, size + 1)
        starts = np.arange(size)
        while len(starts):
            # As many windows as fit, one at least.
            upto = max(1, int(np.searchsorted(np.cumsum(reach[starts]), 16 * AT_ONCE)))
            some, starts = starts[:upto], starts[upto:]
            first = np.repeat(some, reach[some])
            skipped = np.repeat(np.cumsum(reach[some]) - reach[some], reach[some])
            second = first + 1 + np.arange(len(first)) - skipped
            one, two = order[first], order[second]
            # A pair occurs once per direction, so plain indexing counts it.
            counts[np.minimum(one, two) * size + np.maximum(one, two)] += 1
    left = np.flatnonzero(counts >= max(1, least_count(FIRST, chance, LOSS)))
    one, two = left // size, left % size
    if apart is not None:
        met = apart[one] != apart[two]
        one, two = one[met], two[met]
    asked = least_count(PROJECTIONS, chance, LOSS)
    kept = []
    for begin in range(0, len(one), AT_ONCE):
        a, b = one[begin : begin + AT_ONCE], two[begin : begin + AT_ONCE]
        kept.append((np.abs(along[a] - along[b]) <= width).sum(axis=1) >= asked)
    chosen = np.concatenate(kept) if kept else np.zeros(0, bool)
    return one[chosen], two[chosen]


def _links(units: np.ndarray, codes: np.ndarray, table: int, alike: float, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of a cell that share no cell of an earlier table."""
    one, two = collided(units, alike, apart)
    kept = []
    for begin in range(0, len(one), AT_ONCE):
        a, b = one[begin : begin + AT_ONCE], two[begin : begin + AT_ONCE]
        linked = np.einsum("ij,ij->i", units[a], units[b]) >= alike
        kept.append(linked & ~(codes[a, :table] == codes[b, :table]).any(axis=1))
    chosen = np.concatenate(kept) if kept else np.zeros(0, bool)
    return one[chosen], two[chosen]


def _firsts(size: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    parent = np.arange(size)
    while True:
        least = parent.copy()
        np.minimum.at(least, one, parent[two])
        np.minimum.at(least, two, parent[one])
        least = least[least]
        if (least == parent).all():
            return parent
        parent = least


def _met(dealt: DataFrame, alike: float, medians: dict[int, np.ndarray]) -> DataFrame:
    """(item, links, first): links that an item has in a cell, in rows, and the first item of its component there."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def given() -> Iterator[pa.RecordBatch]:
            items, links, firsts = [], [], []
            for places, units in _by_dim([row["unit"] for row in held]):
                rows = [held[place] for place in places]
                bits, tables, table = rows[0]["bits"], rows[0]["tables"], rows[0]["table"]
                blocks = np.array([row["block"] for row in rows])
                apart = blocks if rows[0]["crossed"] else None
                one, two = _links(units, _codes(units, bits, tables, medians), table, alike, apart)
                copies = np.array([row["copies"] for row in rows])
                total = np.zeros(len(rows), np.int64)
                np.add.at(total, one, copies[two])
                np.add.at(total, two, copies[one])
                first = _firsts(len(rows), one, two)
                for place in np.flatnonzero(total):
                    items.append(rows[place]["item"])
                    links.append(int(total[place]))
                    firsts.append(rows[first[place]]["item"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.binary()), pa.array(links, pa.int64()), pa.array(firsts, pa.binary())], names=["item", "links", "first"]
            )

        unit = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                for row in batch.slice(begin, 512).to_pylist():
                    own = tuple(row[name] for name in CELL_KEY)
                    if held and own != unit:
                        yield from given()
                        held.clear()
                    unit = own
                    held.append(row)
        if held:
            yield from given()

    return dealt.mapInArrow(meet, "item binary, links long, first binary")


#: What names the rows that meet: a cell, and the two of its blocks.
CELL_KEY = ("label", "table", "code", "low", "high")


def _dealt(items: DataFrame, alike: float, medians: dict[int, np.ndarray], cell: int) -> DataFrame:
    """Items in the cells of every table, big cells cut into pairs of blocks; without vectors."""
    plan = F.udf(lambda n: table_plan(n, alike, cell), "struct<bits:int,tables:int>")
    sizes = stage(items.groupBy("label").agg(F.count("*").alias("n")).withColumn("plan", plan("n")).select("label", "plan.*"), "labels")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                plans = list(zip(part.column("bits").to_pylist(), part.column("tables").to_pylist()))
                units = part.column("unit").to_pylist()
                codes: list[list[int]] = [[] for _ in plans]
                for bits, tables in set(plans):
                    own = [place for place, one in enumerate(plans) if one == (bits, tables)]
                    for places, rows in _by_dim([units[place] for place in own]):
                        for place, found in zip(places, _codes(rows, bits, tables, medians).tolist()):
                            codes[own[place]] = found
                columns = [part.column(name) for name in ("item", "label", "bits", "tables")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.list_(pa.int64()))], names=["item", "label", "bits", "tables", "codes"])

    planned = items.select("item", "label", "unit").join(sizes.hint("merge"), "label")
    coded = planned.mapInArrow(post, "item binary, label string, bits int, tables int, codes array<long>")
    posted = stage(coded.select("item", "label", "bits", "tables", F.posexplode("codes").alias("table", "code")), "cells")
    counts = posted.groupBy("label", "table", "code").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    # Written, so that a cell that stays large is dealt to several tasks here.
    sized = posted.join(stage(counts, "cell-sizes").hint("merge"), ["label", "table", "code"])
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    with_other = sized.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return with_other.select(
        "item",
        "label",
        "bits",
        "tables",
        "table",
        "code",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") != F.col("other")).alias("crossed"),
    )


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    alike: float = ALIKE,
    cell: int = CELL,
) -> DataFrame:
    """One row per row: `vec_id`, `n_links`, `component_id` and `kept`.

    Vectors of one label and one dimension are linked if their cosine, in double precision, is `alike` or more; pairs
    below are never linked, others are found with the chance the module states. `n_links` counts the other rows
    linked directly, `component_id` is the smallest vec_id reachable by links, itself included, and that row is kept.
    Rows whose label or vector is null, and vectors that are empty, zero or hold null or non-finite components, link
    with nothing. Rows that repeat a vec_id are judged by their own vectors; a null vec_id never names a component
    that has another. An empty table gives no rows, other columns are not read.
    """
    read = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("embedding"),
        F.col(label).cast("string").alias("label"),
    )
    prepared = stage(_prepared(read), "vectors")
    items = stage(
        prepared.where("item IS NOT NULL")
        .groupBy("label", "item")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("unit").alias("unit")),
        "items",
    )
    largest = items.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    bits, tables = table_plan(largest, alike, cell)
    medians = _medians(items, bits * tables) if bits else {}
    # Vectors come to the cells by their key; a cell's blocks are bounded, and so is what a task holds.
    dealt = (
        _dealt(items, alike, medians, cell)
        .join(items.select("item", "unit", "copies").hint("merge"), "item")
        .repartition(task_count(items), *CELL_KEY)
        .sortWithinPartitions(*CELL_KEY)
    )
    met = stage(_met(dealt, alike, medians), "met")
    links = met.groupBy("item").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("item").alias("u"), F.col("first").alias("v")))
    # Written, so that a large component is dealt to several tasks.
    named = stage(roots.join(items.select(F.col("item").alias("node"), "least").hint("merge"), "node"), "named")
    component = stage(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    rooted = named.join(component.hint("merge"), "root").select(F.col("node").alias("item"), "component_id")
    judged = stage(
        items.select("item", "least", "copies")
        .join(links.hint("merge"), "item", "left")
        .join(rooted.hint("merge"), "item", "left")
        .select(
            "item",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        ),
        "judged",
    )
    result = prepared.select("vec_id", "item").join(judged.hint("merge"), "item", "left")
    # A row without an item is alone.
    component_id = F.when(F.col("item").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        component_id.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
