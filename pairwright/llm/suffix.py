"""Removal of repeated byte strings by external induced suffix sorting.

Every string of `WINDOW` bytes has an anchor: the substring of `ANCHOR` bytes in it with the least hash. Equal
strings have equal anchors, so strings can only repeat where an anchor does. Consecutive strings with one
anchor are a context; equal contexts are one, and the first document that has it keeps it. Different
contexts around one anchor meet in a shard, where the suffixes of all of them are sorted by induction, with
common-prefix values (see `induced`): neighbours that share `WINDOW` bytes begin with the same string, and all
but the first of these repeat.

Tables of repeated anchors and of the contexts to sort are bit filters of fixed size: they may let too much
through, which costs work, and never too little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.induced import mapped, sorted_suffixes
from pairwright.llm.shingles import mix
from pairwright.llm.tables import fresh, task_count, text_slices
from pairwright.staging import stage

WINDOW, ANCHOR = 100, 44
#: Bits of each filter: 8 MB.
FILTER_BITS = 1 << 26
#: Contexts of one anchor above which they are dealt by the bytes beside the anchor, too.
MANY = 2_000
#: Filter of anchors with many contexts.
MANY_BITS = 1 << 20
_PIECE = 1 << 15
#: Shards per task.
SHARDS = 6
#: Windows that are hashed at a time, and texts that are scanned at a time.
_CHUNK, _BATCH_BYTES = 1 << 17, 1 << 20


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(count, np.uint64(base), np.uint64)))


_BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_UP = [_powers(b, _CHUNK + WINDOW) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), _CHUNK + WINDOW) for b in _BASES]


class Contexts:
    """Contexts of some texts: text number, first window, number of windows, place of the anchor; hashes of anchor and content."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        self.data, self.begins = data, ends - [len(t) for t in texts]
        found = [self._chunk(data, ends, at, stop) for at, stop in self._parts(ends)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        first, self.windows, self.place, anchors, names = columns
        self.text = np.searchsorted(ends, first, side="right")
        self.start = first - self.begins[self.text] if len(first) else first
        self.first = first
        self.anchor, self.name = anchors, names

    @staticmethod
    def _parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of windows to hash at once: some whole texts, or a long text alone in steps from its begin.

        So a text's contexts never depend on the texts beside it.
        """
        at = last = 0
        for end in ends.tolist():
            if end - at > _CHUNK and last > at:
                yield at, last
                at = last
            if end - at > _CHUNK:
                yield from ((step, min(end, step + _CHUNK + WINDOW - 1)) for step in range(at, end, _CHUNK))
                at = end
            last = end
        if last > at:
            yield at, last

    @staticmethod
    def _chunk(data: np.ndarray, ends: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, ...]:
        if stop - at < WINDOW:
            return (np.zeros(0, np.int64),) * 5
        part = data[at:stop].astype(np.uint64) + np.uint64(1)
        sums = []
        for up in _UP:
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            sums.append(total)
        hashes = (sums[0][ANCHOR:] - sums[0][:-ANCHOR]) * _DOWN[0][: len(part) - ANCHOR + 1]
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        span, want = 1, WINDOW - ANCHOR + 1
        while 2 * span <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if want > span:
            least = np.minimum(least[: span - want], least[want - span :])
        # A window belongs to the text it begins in and must end in it.
        begin = np.arange(at, at + len(least))
        inside = begin + WINDOW <= ends[np.searchsorted(ends, begin, side="right")]
        own = np.flatnonzero(inside)
        if not len(own):
            return (np.zeros(0, np.int64),) * 5
        place = (least[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(own), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (np.diff(own) != 1)
        opens = np.flatnonzero(fresh)
        first, place = own[opens], place[opens]
        last = own[np.append(opens[1:], len(own)) - 1]
        end = last + WINDOW
        names = (sums[1][end] - sums[1][first]) * _DOWN[1][first]
        return (
            first + at,
            last - first + 1,
            place + at,
            mix(hashes[place]).view(np.int64),
            mix(names + mix((place - first).astype(np.uint64) + np.uint64(1))).view(np.int64),
        )

    def once_per_text(self, some: np.ndarray) -> np.ndarray:
        """Of some contexts, in their order, the first with its content in each text."""
        order = some[np.lexsort((some, self.name[some], self.text[some]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.name[order[1:]] != self.name[order[:-1]]) | (self.text[order[1:]] != self.text[order[:-1]])
        return np.sort(order[fresh])

    def content(self, i: int, begin: int, windows: int) -> bytes:
        """The bytes under some windows of a context."""
        at = int(self.first[i]) + begin
        return self.data[at : at + windows + WINDOW - 1].tobytes()


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Contexts]]:
    """Rows with the contexts of their `text`."""
    for rows, texts in text_slices(batches, "text", 512, _BATCH_BYTES):
        yield rows, Contexts(texts)


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes.view(np.uint64) % np.uint64(bits)


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits(hashes, len(table) * 8)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _rep_key(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)) ^ name.view(np.uint64)).view(np.int64)


def _table(rows: DataFrame, bits: int) -> np.ndarray:
    """A filter out of bit numbers (`bit`): fixed size, so the driver may hold and share it."""
    pieces = (
        rows.select(F.floor(F.col("bit") / _PIECE).cast("long").alias("piece"), (F.col("bit") % _PIECE).alias("at"))
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
        .toLocalIterator()
    )
    table = np.zeros(bits // 8, np.uint8)
    for row in pieces:
        table[row["piece"] * (_PIECE // 8) : (row["piece"] + 1) * (_PIECE // 8)] = np.frombuffer(row["bits"], np.uint8)
    return table


def _repeated_anchors(texts: DataFrame) -> np.ndarray:
    """Filter of the anchors that occur twice or more; anchors that share a bit count as one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, contexts in _scanned(batches):
            bit, n = np.unique(_bits(contexts.anchor, FILTER_BITS).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bit), pa.array(np.minimum(n, 2).astype(np.int32))], names=["bit", "n"])

    counted = texts.mapInArrow(emit, "bit int, n int").groupBy("bit").agg(F.sum("n").alias("n")).where("n > 1")
    return _table(counted.select(F.col("bit").cast("long")), FILTER_BITS)


def _first_contexts(keyed: DataFrame, repeated) -> DataFrame:
    """`anchor`, `name`, `doc`: each content of a repeated anchor's contexts with the smallest document that has it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = repeated.value
        for batch, contexts in _scanned(batches):
            once = contexts.once_per_text(np.flatnonzero(_has(table, contexts.anchor)))
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(contexts.anchor[once]), pa.array(contexts.name[once]), pa.array(docs[contexts.text[once]])],
                names=["anchor", "name", "doc"],
            )

    found = keyed.select("doc", "text").mapInArrow(emit, "anchor long, name long, doc long")
    return found.groupBy("anchor", "name").agg(F.min("doc").alias("doc"))


def _to_sort(keyed: DataFrame, wanted, many) -> DataFrame:
    """Contexts to sort: `route` (equal strings have equal ones), `doc`, `version`, `start`, `bytes`."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crowded = wanted.value, many.value
        for batch, contexts in _scanned(batches):
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            versions = batch.column("version").to_numpy(zero_copy_only=False)
            own = contexts.once_per_text(np.flatnonzero(_has(table, _rep_key(docs[contexts.text], contexts.name))))
            split = _has(crowded, contexts.anchor[own])
            out: list[list] = [[], [], [], []]
            for i, apart in zip(own.tolist(), split.tolist()):
                for route, begin, windows in _halves(contexts, i) if apart else [(int(contexts.anchor[i]), 0, int(contexts.windows[i]))]:
                    for column, value in zip(out, (route, contexts.text[i], contexts.start[i] + begin, contexts.content(i, begin, windows))):
                        column.append(value)
            at = np.array(out[1], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(docs[at]), pa.array(versions[at]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                names=["route", "doc", "version", "start", "bytes"],
            )

    return keyed.mapInArrow(emit, "route long, doc long, version long, start long, bytes binary")


def _halves(contexts: Contexts, i: int) -> Iterator[tuple[int, int, int]]:
    """A crowded anchor's context in two: windows with much before the anchor and with much behind it, dealt by those bytes, too."""
    beside = (WINDOW - ANCHOR) // 2
    first, windows, place = int(contexts.first[i]), int(contexts.windows[i]), int(contexts.place[i])
    # Windows that begin `beside` bytes or more before the anchor all hold these bytes, the others those behind it.
    early = min(windows, max(0, place - beside - first + 1))
    for begin, count, low in ((0, early, place - beside), (early, windows - early, place)):
        if count:
            core = contexts.data[low : low + ANCHOR + beside].tobytes()
            yield int.from_bytes(hashlib.blake2b(core, digest_size=8, key=b"%d" % (low == place)).digest(), "little", signed=True), begin, count


def _repeats_in_shards(rows: DataFrame) -> DataFrame:
    """`doc`, `version`, `start`, `windows`: stretches of strings that begin earlier, too, among the contexts of a shard."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        sizes: list[np.ndarray] = []

        def symbols() -> Iterator[np.ndarray]:
            for batch in batches:
                for held, name in zip(columns, ("doc", "version", "start", "route")):
                    held.append(batch.column(name).to_numpy(zero_copy_only=False))
                contents = batch.column("bytes").to_pylist()
                sizes.append(np.array([len(c) for c in contents], np.int64))
                lengths = sizes[-1] + 1
                part = np.ones(lengths.sum(), np.uint16)
                part[np.cumsum(lengths) - 1] = 0
                part[part != 0] = np.frombuffer(b"".join(contents), np.uint8).astype(np.uint16) + 1
                yield part

        text = mapped(symbols(), np.uint16)
        if not len(text):
            return
        doc, version, start, route = (np.concatenate(held) for held in columns)
        length = np.concatenate(sizes)
        # A context that is alone on its route came through a filter by chance: it has nothing to be compared with.
        _, at, met = np.unique(route, return_inverse=True, return_counts=True)
        some = met[at] > 1
        if not some.any():
            return
        text = mapped(_kept(text, length, some), np.uint16)
        doc, version, start, length = doc[some], version[some], start[some], length[some]
        begin = np.cumsum(length + 1) - length - 1
        hits: list[np.ndarray] = []
        # Strings that go on from one batch to the next are carried over.
        held_p, held_q = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for positions, prefixes in sorted_suffixes(text, WINDOW):
            positions, prefixes = np.append(held_p, positions), np.append(held_q, prefixes)
            breaks = np.flatnonzero(prefixes < WINDOW)
            cut = breaks[-1] if len(breaks) and breaks[-1] else 0
            if cut:
                hits.append(_later(positions[:cut], prefixes[:cut], begin, length, doc, start))
            held_p, held_q = positions[cut:], prefixes[cut:]
        hits.append(_later(held_p, held_q, begin, length, doc, start))
        at = np.sort(np.concatenate(hits))
        if not len(at):
            return
        opens = np.flatnonzero(np.append(True, np.diff(at) != 1))
        counts = np.diff(opens, append=len(at))
        owner = np.searchsorted(begin, at[opens], side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[owner]), pa.array(version[owner]), pa.array(start[owner] + at[opens] - begin[owner]), pa.array(counts)],
            names=["doc", "version", "start", "windows"],
        )

    dealt = rows.repartition(SHARDS * task_count(rows), "route")
    return dealt.mapInArrow(find, "doc long, version long, start long, windows long")


def _kept(text: np.ndarray, length: np.ndarray, some: np.ndarray) -> Iterator[np.ndarray]:
    """The contexts of a text that are among `some`, a number of them at a time."""
    begin = np.cumsum(length + 1) - length - 1
    for at in range(0, len(length), 1 << 14):
        part = slice(at, at + (1 << 14))
        stretch = text[begin[part][0] : begin[part][-1] + length[part][-1] + 1]
        yield stretch[np.repeat(some[part], length[part] + 1)]


def _later(positions, prefixes, begin, length, doc, start) -> np.ndarray:
    """Positions of whole windows that share a window's length with others of which one begins earlier in the corpus."""
    if not len(positions):
        return positions
    group = np.cumsum(prefixes < WINDOW)
    several = np.bincount(group, minlength=group[-1] + 1)[group] > 1
    positions, group = positions[several], group[several]
    owner = np.searchsorted(begin, positions, side="right") - 1
    place = start[owner] + positions - begin[owner]
    order = np.lexsort((place, doc[owner], group))
    group, positions, d, p = group[order], positions[order], doc[owner][order], place[order]
    opens = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(opens, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    return positions[(d != d[first]) | (p != p[first])]


def _cut(repeated):
    """A column function that removes repeated strings from a text."""

    @F.arrow_udf("struct<kept: binary, n_bytes: long, n_removed: long, n_spans: long>")
    def cut(texts: pa.Array, firsts: pa.Array, starts: pa.Array, windows: pa.Array) -> pa.Array:
        table = repeated.value
        bodies = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        kept, removed, spans = [], [], []
        at = 0
        while at < len(bodies):
            stop, size = at + 1, len(bodies[at])
            while stop < len(bodies) and size + len(bodies[stop]) <= _BATCH_BYTES:
                size += len(bodies[stop])
                stop += 1
            contexts = Contexts(bodies[at:stop])
            own = np.flatnonzero(_has(table, contexts.anchor))
            edges = np.searchsorted(contexts.text[own], np.arange(stop - at + 1))
            for i in range(at, stop):
                mine = own[edges[i - at] : edges[i - at + 1]]
                gone = np.zeros(len(bodies[i]) + 1, np.int64)
                if len(mine):
                    # A context stays where this document is the first with it, at its first place there.
                    names = contexts.name[mine]
                    stays = np.zeros(len(mine), bool)
                    stays[np.unique(names, return_index=True)[1]] = True
                    stays &= np.isin(names, np.array(firsts[i].as_py() or [], np.int64))
                    lost = mine[~stays]
                    gone += _marks(contexts.start[lost], contexts.windows[lost], len(bodies[i]))
                if starts[i].is_valid:
                    gone += _marks(np.array(starts[i].as_py()), np.array(windows[i].as_py()), len(bodies[i]))
                covered = np.cumsum(gone)[:-1] > 0
                left = np.frombuffer(bodies[i], np.uint8)[~covered] if covered.any() else None
                kept.append(bodies[i] if left is None else left.tobytes())
                removed.append(int(covered.sum()))
                spans.append(int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum()))
            at = stop
        columns = [pa.array(kept, pa.binary()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        return pa.StructArray.from_arrays(columns, names=["kept", "n_bytes", "n_removed", "n_spans"])

    return cut


def _marks(starts: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """+1 where a removed stretch begins and -1 behind its end."""
    out = np.zeros(size + 1, np.int64)
    np.add.at(out, starts, 1)
    np.add.at(out, starts + windows + WINDOW - 1, -1)
    return out


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with a struct `_cut` as last column: `kept` (the bytes left), `n_bytes`, `n_removed`, `n_spans` (removed stretches).

    A byte goes if a string of `WINDOW` bytes that covers it also begins earlier: in a document with a smaller
    doc_id (null: the largest), or before it in the same one. Strings are judged on the input and do not cross
    documents. Null texts are empty; texts below `WINDOW` bytes stay. Rows that repeat a doc_id are one
    document to each other: of a string in both, the earlier place stays, and both if the places are equal.
    Other columns stay as they are. Strings are told apart by 128 bits of their context's hashes, or their bytes.
    """
    context = docs.sparkSession.sparkContext
    document = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select(document.alias("doc"), F.xxhash64(text).alias("version"), F.col(text).cast("string").alias("text"))
    repeated = context.broadcast(_repeated_anchors(keyed.select("text")))
    firsts = stage(_first_contexts(keyed, repeated), "first-contexts")
    counts = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    varied = stage(firsts.join(counts.hint("merge"), "anchor").select("doc", "name", F.struct("anchor", "n").alias("of")), "varied-contexts")
    wanted = context.broadcast(_table(_rep_bits(varied), FILTER_BITS))
    many = context.broadcast(_table(varied.where(F.col("of.n") > MANY).select(F.col("of.anchor").bitwiseAND(F.lit(MANY_BITS - 1)).alias("bit")), MANY_BITS))
    repeats = _repeats_in_shards(_to_sort(keyed, wanted, many))
    of_doc, of_version, first_names, found, result = fresh(docs, "_doc", "_version", "_firsts", "_found", "_cut")
    by_doc = firsts.groupBy(F.col("doc").alias(of_doc)).agg(F.collect_list("name").alias(first_names))
    by_version = repeats.groupBy(F.col("doc").alias(of_doc), F.col("version").alias(of_version)).agg(
        F.collect_list(F.struct("start", "windows")).alias(found)
    )
    joined = (
        docs.withColumns({of_doc: document, of_version: F.xxhash64(text)})
        .join(by_doc.hint("merge"), of_doc, "left")
        .join(by_version.hint("merge"), [of_doc, of_version], "left")
    )
    cut = _cut(repeated)(F.col(text).cast("string"), first_names, f"{found}.start", f"{found}.windows")
    return joined.select(*[F.col(c) for c in docs.columns], cut.alias(result))


def _rep_bits(varied: DataFrame) -> DataFrame:
    """The bit of each context to sort, as `_to_sort` looks it up."""

    @F.arrow_udf("long")
    def bit(docs: pa.Array, names: pa.Array) -> pa.Array:
        keys = _rep_key(docs.to_numpy(zero_copy_only=False).copy(), names.to_numpy(zero_copy_only=False).copy())
        return pa.array(_bits(keys, FILTER_BITS).astype(np.int64))

    return varied.select(bit("doc", "name").alias("bit"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated strings cut out of `text`; characters of which only a part is left go as well."""

    @F.arrow_udf("string")
    def readable(kept: pa.Array) -> pa.Array:
        return pa.array([k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())

    cut = cut_repeats(docs, doc_id, text)
    result = cut.columns[-1]
    changed = F.when(F.col(f"{result}.n_removed") > 0, readable(f"{result}.kept")).otherwise(F.col(text))
    return cut.select(*[changed.alias(c) if c == text else F.col(c) for c in docs.columns])
