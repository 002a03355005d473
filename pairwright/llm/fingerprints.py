"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch is a row of cells; each paragraph digest is added to three of them. Subtracting the sketches of two
versions leaves the digests that only one of them has, and peeling (take a cell that holds a single digest,
remove it from its other cells, go on) recovers these one by one. Where peeling gets stuck, the difference
was too large for the cells; the pair is tried again with twice as many.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import hashed_sample, task_count

#: Cells of a fingerprint, a multiple of the three that each digest goes to.
CELLS = 24
HASHES = 3
#: Paragraphs above this many characters are cut further, after words chosen by their own hash.
LONG_PARAGRAPH = 240
_CUT_BITS = 7
#: Documents whose sketches a task handles together; ranges of ids per task and sampled ids per range.
TOGETHER, RANGES, SAMPLED = 256, 4, 20
_ENDS = re.compile(r"\n+|(?<=[.!?])\s+")


def paragraphs(text: str) -> list[str]:
    """Lines, cut after sentence ends; longer stretches are cut after words whose crc32 ends in three zero bits."""
    out = []
    for part in _ENDS.split(text):
        if len(part) <= LONG_PARAGRAPH:
            if part:
                out.append(part)
            continue
        run: list[str] = []
        for word in part.split(" "):
            run.append(word)
            if not zlib.crc32(word.encode("utf-8", "replace")) & _CUT_BITS:
                out.append(" ".join(run))
                run = []
        if run:
            out.append(" ".join(run))
    return out


def digests(text: str) -> np.ndarray:
    """64-bit digests of a text's paragraphs; the nth copy of a paragraph has its own digest."""
    seen: dict[str, int] = {}
    out = []
    for paragraph in paragraphs(text):
        nth = seen.get(paragraph, 0)
        seen[paragraph] = nth + 1
        copy = b"\n%d" % nth if nth else b""  # no paragraph holds a line feed
        out.append(xxhash.xxh3_64_intdigest(paragraph.encode("utf-8", "surrogatepass") + copy))
    return np.array(out, np.uint64)


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 64-bit keys for each salt (the finalizer of splitmix64)."""
    x = keys + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each key, one in each third; another choice for each sketch size."""
    third = cells // HASHES
    return np.stack([_mix(keys, 2 + h + HASHES * cells) % np.uint64(third) + np.uint64(h * third) for h in range(HASHES)], 1).astype(np.int64)


@dataclass
class Sketches:
    """Sketches of many documents, one row each: digests per cell, their xor, and the xor of their checks."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], cells: int = CELLS) -> Sketches:
        keys = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = (row[:, None] * cells + _places(keys, cells)).ravel()
        own = cls(np.zeros(len(texts) * cells, np.int32), np.zeros(len(texts) * cells, np.uint64), np.zeros(len(texts) * cells, np.uint32))
        np.add.at(own.count, at, 1)
        np.bitwise_xor.at(own.key, at, np.repeat(keys, HASHES))
        np.bitwise_xor.at(own.check, at, np.repeat(_checks(keys), HASHES))
        return cls(*(x.reshape(len(texts), cells) for x in (own.count, own.key, own.check)))

    def __sub__(self, other: Sketches) -> Sketches:
        return Sketches(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def pick(self, rows: np.ndarray) -> Sketches:
        return Sketches(self.count[rows], self.key[rows], self.check[rows])

    def packed(self) -> list[str]:
        """Each sketch as text: its cells in order, little-endian, base64."""
        cells = np.empty(self.count.shape, np.dtype([("n", "<i4"), ("k", "<u8"), ("c", "<u4")]))
        cells["n"], cells["k"], cells["c"] = self.count, self.key, self.check
        return [base64.b64encode(row.tobytes()).decode() for row in cells]


def _checks(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1) >> np.uint64(32)).astype(np.uint32)


def peel(difference: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What subtracted sketches held: rows, digests and signs (1: only the first had it, -1: only the second), and which rows came out empty."""
    rows, cells = difference.count.shape
    count, key, check = (x.ravel().copy() for x in (difference.count, difference.key, difference.check))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        single = np.flatnonzero(np.abs(count) == 1)
        single = single[_checks(key[single]) == check[single]]
        if not len(single):
            break
        at_row, keys, signs = single // cells, key[single], count[single]
        # A digest alone in several of its cells is taken once.
        order = np.lexsort((keys, at_row))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(at_row[order]) != 0) | (keys[order][1:] != keys[order][:-1])
        own = order[first]
        at_row, keys, signs = at_row[own], keys[own], signs[own]
        at = (at_row[:, None] * cells + _places(keys, cells)).ravel()
        np.subtract.at(count, at, np.repeat(signs, HASHES))
        np.bitwise_xor.at(key, at, np.repeat(keys, HASHES))
        np.bitwise_xor.at(check, at, np.repeat(_checks(keys), HASHES))
        found.append((at_row, keys, signs))
        if sum(len(f[0]) for f in found) > 2 * count.size:  # a check matched by chance: not decodable at this size
            break
    empty = ~((count != 0) | (key != 0) | (check != 0)).reshape(rows, cells).any(1)
    joined = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)]
    return *joined, empty


def recovered(first: list[np.ndarray], second: list[np.ndarray], sketched: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest lists, the digests only the first and only the second has, by peeling.

    `sketched` are both sides' sketches of `CELLS` cells where they are at hand.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2] * len(first)
    left, cells = np.arange(len(first)), CELLS
    while len(left):
        if sketched is not None and cells == CELLS:
            a, b = sketched
        else:
            a, b = (Sketches.of([side[i] for i in left], cells) for side in (first, second))
        rows, keys, signs, empty = peel(a - b)
        order = np.argsort(rows, kind="stable")
        rows, keys, signs = rows[order], keys[order], signs[order]
        edges = np.searchsorted(rows, np.arange(len(left) + 1))
        for at in np.flatnonzero(empty):
            own = slice(edges[at], edges[at + 1])
            out[left[at]] = keys[own][signs[own] > 0], keys[own][signs[own] < 0]
        left, cells = left[~empty], 2 * cells
        # Two equal digests in one text cancel each other out at any size: then the lists themselves decide.
        hopeless = np.array([cells > 32 * (len(first[i]) + len(second[i]) + CELLS) for i in left], bool)
        for i in left[hopeless]:
            out[i] = np.setdiff1d(first[i], second[i]), np.setdiff1d(second[i], first[i])
        left = left[~hopeless]
    return out


def likeness(first: list[np.ndarray], second: list[np.ndarray], sketched: tuple[Sketches, Sketches]) -> list[float]:
    """Common paragraphs over all paragraphs of each pair; two texts without any are alike."""
    out = []
    for a, b, (only_a, only_b) in zip(first, second, recovered(first, second, sketched)):
        together = len(a) + len(only_b)
        out.append((len(a) - len(only_a)) / together if together else 1.0)
    return out


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(name, pa.string()) for name in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [(name, pa.float64()) for name in ("near_edited", "near_next")]
)
_LEAST = -(1 << 63)


def _compare_neighbours(table: pa.Table) -> pa.Table:
    """One range of documents, with the document that follows its last one marked as `guest`."""
    ids = [_LEAST if i is None else i for i in table["doc_id"].to_pylist()]
    texts = [t or "" for t in table["body"].to_pylist()]
    guest = table["guest"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (guest[i], -ids[i], texts[i]))
    own = [i for i in order if not guest[i]]
    follower = order[len(own)] if len(order) > len(own) else own[0]
    out: list[list] = [[] for _ in _OUT]
    for at in range(0, len(own), TOGETHER):
        some = [*own[at : at + TOGETHER], own[at + TOGETHER] if at + TOGETHER < len(own) else follower]
        bodies = [texts[i] for i in some]
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(bodies, bodies[1:])]
        own_digests, edited_digests = [digests(t) for t in bodies], [digests(t) for t in edited]
        sketches, edited_sketches = Sketches.of(own_digests), Sketches.of(edited_digests)
        n = len(edited)
        columns = (
            [table["doc_id"][i].as_py() for i in some[:n]],
            [len(t) for t in bodies[:n]],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            sketches.packed()[:n],
            edited_sketches.packed(),
            likeness(own_digests[:n], edited_digests, (sketches.pick(np.arange(n)), edited_sketches)),
            likeness(own_digests[:n], own_digests[1:], (sketches.pick(np.arange(n)), sketches.pick(np.arange(1, n + 1)))),
        )
        for column, values in zip(out, columns):
            column.extend(values)
    return pa.table([pa.array(column, field.type) for column, field in zip(out, _OUT)], schema=_OUT)


def _range_column(borders: list[int]) -> Column:
    """The range of an id: how many borders lie below it."""
    edges = np.array(borders, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64)).astype(np.int32))

    return range_of(F.coalesce("doc_id", F.lit(_LEAST)))


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document are.

    Documents are ordered by descending doc_id, null last, rows that repeat an id by their text; the first
    follows the last, so a single document follows itself. The edited text has the last third of the
    characters replaced by the first as many of the next document. Likeness is the share of common
    paragraphs; a null text is empty, and two texts without paragraphs are alike. One row per row of `docs`;
    columns besides the two read are ignored.
    """
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    ids = read.select("doc_id")
    ranges = RANGES * task_count(docs)
    sample = hashed_sample(ids.where("doc_id IS NOT NULL"), SAMPLED * ranges, "doc_id").collect()
    heads = sorted(row["doc_id"] for row in sample)
    borders = [heads[len(heads) * i // ranges] for i in range(1, ranges)] if heads else []
    # The first document of a range, in descending order, follows the last one of the range above.
    tops = sorted(
        (row["part"], row["top"])
        for row in ids.withColumn("part", _range_column(borders))
        .groupBy("part")
        .agg(F.coalesce(F.max("doc_id"), F.lit(_LEAST)).alias("top"))
        .collect()  # a row per range
    )
    above = {top: part for (_, top), (part, _) in zip(tops, tops[1:] + tops[:1])}
    own = F.array(F.struct(_range_column(borders).alias("part"), F.lit(False).alias("guest")))
    if above:
        is_top = F.coalesce("doc_id", F.lit(_LEAST)).isin(list(above))
        targets = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
        visit = F.array(F.struct(targets[F.coalesce("doc_id", F.lit(_LEAST))].alias("part"), F.lit(True).alias("guest")))
        own = F.when(is_top, F.concat(own, visit)).otherwise(own)
    dealt = read.withColumn("to", F.explode(own)).select("doc_id", "body", "to.part", "to.guest")
    kinds = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return dealt.groupBy("part").applyInArrow(_compare_neighbours, kinds)
