"""Encoding and decoding with a merge-type SentencePiece vocabulary, with seeded merge-dropout.

A text starts as single characters; an agenda holds the neighbours that together are a piece, best piece
first and leftmost among equals. Each candidate taken from the agenda is skipped if its keyed hash falls
below the dropout rate, otherwise merged. No piece has a blank after another character or a line feed, so
texts are cut there.

The hash is keyed by seed, document and the stretch's place in it, so every occurrence of a stretch draws for
itself. A worker remembers what no draw decides: which candidates a stretch's agenda offers without a skip,
and the ids it then has. Occurrences that skip one are worked off side by side, a candidate of each at a time,
and not remembered. The same seed gives the same ids on every run and cluster.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.llm.tables import give_back, text_slices

DROPOUT = 0.1
SEED = 17
#: Half the stretches that a worker remembers before it starts anew; those before are looked up a while longer.
REMEMBERED = 60_000
#: Symbols up to which the agenda is a plain list.
FEW = 24
#: Stretches that are worked off side by side.
BESIDE = 1 << 15
#: Texts, and bytes of them, that a task reads at a time.
TOGETHER, TEXT_BYTES = 1024, 1 << 21
#: Bytes of ids that are decoded at a time.
ID_BYTES = 1 << 17
_BLANK = "▁"
_TAIL = ".,!?;:"
#: What `_stretches` cuts texts into.
_STRETCH = re.compile("\n| *[^ \n]+| +")
_MASK = 0xFFFFFFFFFFFFFFFF
_ODD = 0x9E3779B97F4A7C15
_NONE = 1 << 40
#: No place, in arrays; and what places are multiplied by to be ordered with symbols' numbers.
_NOTHING, _SLOTS = 1 << 25, 32


def _drawn(x: int) -> int:
    """32 bits of a candidate in its occurrence."""
    x = x * _ODD & _MASK
    return ((x ^ x >> 32) * _ODD & _MASK) >> 32


def _drawn_all(x: np.ndarray) -> np.ndarray:
    """`_drawn` of many candidates."""
    x = x * np.uint64(_ODD)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(_ODD)) >> np.uint64(32)


class PairTable:
    """Places of pairs of symbols, looked up many at a time: an open hash table of at most a quarter full."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1 << 40, np.int64)
        self.places = np.full(1 << bits, _NOTHING, np.int32)
        both = np.array(list(pairs), np.int64).reshape(-1, 2)
        keys, places = both[:, 0] << 20 | both[:, 1], np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._first(keys)
        while len(keys):
            _, own = np.unique(at, return_index=True)
            own = own[self.places[at[own]] == _NOTHING]
            self.keys[at[own]], self.places[at[own]] = keys[own], places[own]
            left = np.ones(len(keys), bool)
            left[own] = False
            keys, places, at = keys[left], places[left], at[left] + 1 & self.last

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_ODD)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair's piece; `_NOTHING` if it has none, as symbols below 0 have none."""
        keys = left.astype(np.int64) << 20 | right
        at = self._first(keys)
        out = self.places[at]
        open_at = np.flatnonzero((self.keys[at] != keys) & (out != _NOTHING))
        at = at[open_at]
        while len(open_at):
            at = at + 1 & self.last
            out[open_at] = found = self.places[at]
            still = (self.keys[at] != keys[open_at]) & (found != _NOTHING)
            open_at, at = open_at[still], at[still]
        return out


def _stretches(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The stretches of all texts in a row, and how many each text has: a line feed, or blanks with what follows them up to the next."""
    packed = [(" " + text).encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    joined = b"".join(packed)
    data, sizes = np.frombuffer(joined, np.uint8), np.fromiter(map(len, packed), np.int64, len(packed))
    feed, blank = data == 10, data == 32
    opens = feed.copy()
    opens[1:] |= feed[:-1] | blank[1:] & ~blank[:-1]
    begins = np.cumsum(sizes) - sizes
    opens[begins[sizes > 0]] = True
    starts = np.flatnonzero(opens)
    offsets = pa.py_buffer(np.append(starts, len(joined)))
    cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(joined)])
    return cut, np.diff(np.searchsorted(starts, [*begins, len(joined)]))


class Outcome:
    """What a stretch becomes without a skip, and the candidates offered; a long one has no ids here."""

    __slots__ = ("candidates", "ids", "stretch")

    def __init__(self, stretch: str, ids: bytes | None, candidates: bytes) -> None:
        self.stretch, self.ids, self.candidates = stretch, ids, candidates


class Parts:
    """Numbers of several things in a row: those of one are `flat[begins[at] : begins[at] + sizes[at]]`."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes, self.begins = flat, sizes, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, packed: list[bytes], kind: type) -> Parts:
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(kind).itemsize
        return cls(np.frombuffer(b"".join(packed), kind), sizes)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The numbers of some, in a row."""
        sizes = self.sizes[at]
        places = np.repeat(self.begins[at] - (np.cumsum(sizes) - sizes), sizes)
        places += np.arange(len(places))
        return self.flat[places]

    def packed(self) -> list[bytes]:
        joined, ends = self.flat.tobytes(), ((self.begins + self.sizes) * self.flat.itemsize).tolist()
        return list(map(joined.__getitem__, map(slice, [0, *ends], ends)))


class Pieces:
    """A vocabulary: ids of pieces in order of their scores, bytes of ids."""

    _workers: ClassVar[dict[str, Pieces]] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        text = [model.id_to_piece(i) for i in ids]
        self.special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte = {int(text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if i not in self.special and not model.is_byte(i)]
        # Symbols are numbered by place, the best piece first; candidates compare by it.
        ordered = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.id_at = ordered
        self.place = {text[i]: place for place, i in enumerate(ordered)}
        self.pairs = {
            (self.place[piece[:cut]], self.place[piece[cut:]]): place
            for piece, place in self.place.items()
            for cut in range(1, len(piece))
            if piece[:cut] in self.place and piece[cut:] in self.place
        }
        self.beside = PairTable(self.pairs)
        self.ids_of = np.array(ordered, np.uint32)
        # By character; the vocabulary's own blank stands for a blank, that character itself has no piece.
        self.place_of = np.full(0x110000, -1, np.int32)
        for piece, place in self.place.items():
            if len(piece) == 1:
                self.place_of[ord(piece)] = place
        self.place_of[[ord(" "), ord(_BLANK)]] = self.place_of[ord(_BLANK)], -1
        self.neighbours = {pair for piece in self.place for pair in zip(piece, piece[1:])}
        self.bytes = [b""] * len(text)
        for i in plain:
            self.bytes[i] = text[i].replace(_BLANK, " ").encode()
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        self.spelled = Parts.of(self.bytes, np.uint8)
        # By stretch: its outcome without skips, or those of its two parts; a long one is worked off each time.
        self.known: dict[str, tuple[Outcome, ...]] = {}
        self.older: dict[str, tuple[Outcome, ...]] = {}
        self.size = 0
        self.dropout, self.seed = 0.0, 0

    def set(self, dropout: float, seed: int) -> None:
        """Nothing that is remembered hangs on them."""
        self.dropout, self.seed = dropout, seed

    def forget(self) -> None:
        self.known, self.older, self.size = {}, {}, 0

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def merge(self, symbols: list[int], key: int) -> list[int]:
        """Work off the agenda of some symbols (numbers of pieces) and return what they became."""
        return self._merge_few(symbols, key) if len(symbols) <= FEW else self._merge_many(symbols, key)

    def _merge_few(self, symbols: list[int], key: int) -> list[int]:
        """The agenda as a plain list, a place per pair: for a few symbols shorter work than a heap."""
        pairs, limit = self.pairs, int(self.dropout * 2**32)
        agenda = [pairs.get(pair, _NONE) for pair in zip(symbols, symbols[1:])]
        starts = list(range(len(symbols)))
        while agenda and (place := min(agenda)) != _NONE:
            at = agenda.index(place)
            if limit and _drawn(key ^ (place << 32 | starts[at])) < limit:
                agenda[at] = _NONE
                continue
            symbols[at] = place
            del symbols[at + 1], starts[at + 1], agenda[at]
            if at:
                agenda[at - 1] = pairs.get((symbols[at - 1], place), _NONE)
            if at < len(agenda):
                agenda[at] = pairs.get((place, symbols[at + 1]), _NONE)
        return symbols

    def _offered(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The agenda of `_merge_few` without skips: what the symbols became, and the candidates offered."""
        pairs, offered = self.pairs.get, []
        agenda = [pairs(pair, _NONE) for pair in zip(symbols, symbols[1:])]
        starts = list(range(len(symbols)))
        while agenda and (place := min(agenda)) != _NONE:
            at = agenda.index(place)
            offered.append(place << 32 | starts[at])
            symbols[at] = place
            del symbols[at + 1], starts[at + 1], agenda[at]
            if at:
                agenda[at - 1] = pairs((symbols[at - 1], place), _NONE)
            if at < len(agenda):
                agenda[at] = pairs((place, symbols[at + 1]), _NONE)
        return symbols, offered

    def _side_by_side(self, symbols: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agendas of `_merge_few` of many stretches, a column each, ended by -1: in each turn every stretch takes its next candidate.

        What the symbols became (below 0 where one is gone); without keys nothing is skipped, and the candidates
        offered and their columns are returned, those of a column in order.
        """
        slots, columns = symbols.shape
        out, index, limit = symbols.copy(), np.arange(columns), np.uint64(int(self.dropout * 2**32))
        number = np.arange(slots, dtype=np.int32)[:, None]
        after, before = np.repeat(number + 1, columns, 1), np.repeat(number - 1, columns, 1)
        agenda = np.full(symbols.shape, _NOTHING * _SLOTS, np.int32)
        agenda[:-1] = self.beside(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(slots - 1, columns) * _SLOTS + number[:-1]
        offered, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        while True:
            best = agenda.min(0) if columns else agenda[0]
            column = np.flatnonzero(best < _NOTHING * _SLOTS)
            if 2 * len(column) < len(index):
                out[:, index] = symbols
                if not len(column):
                    break
                symbols, after, before, agenda = (x[:, column] for x in (symbols, after, before, agenda))
                index, best, column = index[column], best[column], np.arange(len(column))
            best = best[column]
            place, at = best // _SLOTS, best % _SLOTS
            candidate = place.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)
            if keys is None:
                offered.append(candidate)
                of.append(index[column])
            else:
                skipped = _drawn_all(keys[index[column]] ^ candidate) < limit
                agenda[at[skipped], column[skipped]] = _NOTHING * _SLOTS
                column, place, at = column[~skipped], place[~skipped], at[~skipped]
            right = after[at, column]
            following, leader = after[right, column], before[at, column]
            symbols[at, column], symbols[right, column] = place, -2
            agenda[right, column] = _NOTHING * _SLOTS
            after[at, column], before[following, column] = following, at
            agenda[at, column] = self.beside(place, symbols[following, column]) * _SLOTS + at
            # Before the first symbol is the last slot, which holds none.
            agenda[leader, column] = self.beside(symbols[leader, column], place) * _SLOTS + leader % slots
        return out, np.concatenate(offered), np.concatenate(of)

    def _work_off(self, stretches: list[str], keys: np.ndarray | None = None, of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, Parts, Parts]]:
        """Of stretches of at most `FEW` characters: numbers of some, their ids and the candidates offered.

        With keys, `of` says which stretch each key's occurrence is of; the numbers are those of the keys and no
        candidates are returned.
        """
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.cumsum(lengths)
        places = self.place_of[np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)]
        odd = np.zeros(len(stretches), bool)
        odd[np.searchsorted(ends, np.flatnonzero(places < 0), "right")] = True
        of = np.arange(len(stretches)) if of is None else of
        sizes, begins, odd = lengths[of], (ends - lengths)[of], odd[of]
        if alone := np.flatnonzero(odd).tolist():
            if keys is None:
                outcomes = [self.outcome(stretches[of[at]]) for at in alone]
                ids, offered = [own.ids for own in outcomes], [own.candidates for own in outcomes]
            else:
                ids, offered = [self.stretch_ids(stretches[of[at]], int(keys[at])) for at in alone], []
            yield np.array(alone), Parts.of(ids, np.uint32), Parts.of(offered, np.uint64)
        # Those of about one length together.
        order = np.flatnonzero(~odd)
        order = order[np.argsort(sizes[order], kind="stable")]
        for begin in range(0, len(order), BESIDE):
            own = order[begin : begin + BESIDE]
            slots = np.arange(sizes[own[-1]] + 1)[:, None]
            inside = slots < sizes[own]
            symbols = np.full(inside.shape, -1, np.int32)
            symbols[inside] = places[(begins[own] + slots)[inside]]
            became, offered, column = self._side_by_side(symbols, None if keys is None else keys[own])
            became = np.ascontiguousarray(became.T)
            left = became >= 0
            yield own, Parts(self.ids_of[became[left]], left.sum(1)), Parts(
                offered[np.argsort(column, kind="stable")], np.bincount(column, minlength=len(own))
            )

    def _merge_many(self, symbols: list[int], key: int) -> list[int]:
        """The agenda as a heap."""
        pairs, limit, size = self.pairs.get, int(self.dropout * 2**32), len(symbols)
        agenda = []
        for left, pair in enumerate(zip(symbols, symbols[1:])):
            place = pairs(pair)
            if place is not None:
                agenda.append(place << 32 | left)
        heapq.heapify(agenda)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        gone = bytearray(size)
        while agenda:
            candidate = heapq.heappop(agenda)
            left, place = candidate & 0xFFFFFFFF, candidate >> 32
            right = after[left]
            # A side that was merged meanwhile no longer makes this piece.
            if gone[left] or right >= size or pairs((symbols[left], symbols[right])) != place:
                continue
            if limit and _drawn(key ^ candidate) < limit:
                continue
            symbols[left], gone[right] = place, 1
            after[left] = follower = after[right]
            if follower < size:
                before[follower] = left
                joined = pairs((place, symbols[follower]))
                if joined is not None:
                    heapq.heappush(agenda, joined << 32 | left)
            leader = before[left]
            if leader >= 0:
                joined = pairs((symbols[leader], place))
                if joined is not None:
                    heapq.heappush(agenda, joined << 32 | leader)
        return [symbol for symbol, out in zip(symbols, gone) if not out]

    def _spelled(self, character: str) -> list[int]:
        return [self.byte[b] for b in character.encode("utf-8", "surrogatepass")]

    def _symbols(self, stretch: str) -> tuple[list[int], list[str]]:
        """A blank is the vocabulary's own blank; that character itself, and any other without a piece, is spelled in bytes.

        Characters that are no piece are numbered below 0 by their place among those; no pair has them.
        """
        place, missing = self.place.get, []
        symbols = list(map(place, stretch.replace(" ", _BLANK)))
        if None not in symbols and _BLANK not in stretch:
            return symbols, missing
        symbols = []
        for character in stretch:
            symbol = place(_BLANK if character == " " else character) if character != _BLANK else None
            if symbol is None:
                missing.append(character)
                symbol = -len(missing)
            symbols.append(symbol)
        return symbols, missing

    def _packed(self, symbols: list[int], missing: list[str]) -> bytes:
        at = self.id_at
        if not missing:
            return array("I", [at[symbol] for symbol in symbols]).tobytes()
        out: list[int] = []
        for symbol in symbols:
            out += [at[symbol]] if symbol >= 0 else self._spelled(missing[-symbol - 1])
        return array("I", out).tobytes()

    def stretch_ids(self, stretch: str, key: int) -> bytes:
        """Packed ids of a stretch whose occurrence has this key."""
        symbols, missing = self._symbols(stretch)
        return self._packed(self.merge(symbols, key), missing)

    def outcome(self, stretch: str) -> Outcome:
        symbols, missing = self._symbols(stretch)
        symbols, offered = self._offered(symbols)
        return Outcome(stretch, self._packed(symbols, missing), array("Q", offered).tobytes())

    def _learn(self, stretches: set[str]) -> None:
        if self.size > 2 * REMEMBERED:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        new = stretches.difference(known)
        if older:
            again = new.intersection(older)
            known.update(zip(again, map(older.__getitem__, again)))
            self.size += len(again)
            new -= again
        # Marks after a word stand alone where no piece has them beside its last character.
        split: dict[str, tuple[str, str]] = {}
        for stretch in [stretch for stretch in new if stretch[-1] in _TAIL]:
            head = stretch.rstrip(_TAIL)
            if head and (head[-1], stretch[len(head)]) not in self.neighbours:
                split[stretch] = head, stretch[len(head) :]
        new.difference_update(split)
        new.update(part for part in chain.from_iterable(split.values()) if part not in known)
        known.update((part, (Outcome(part, None, b""),)) for part in new if len(part) > FEW)
        few = [part for part in new if len(part) <= FEW]
        self.size += len(few)
        for numbers, ids, candidates in self._work_off(few):
            own = list(map(few.__getitem__, numbers.tolist()))
            known.update(zip(own, zip(map(Outcome, own, ids.packed(), candidates.packed()))))
        for stretch, (head, tail) in split.items():
            known[stretch] = known[head] + known[tail]

    def _keys(self, document: int, places: int) -> np.ndarray:
        """A key for every place of a document."""
        return self._all_keys([document], np.array([places]))

    def _all_keys(self, documents: list[int], places: np.ndarray) -> np.ndarray:
        """The keys of several documents in a row."""
        seed = self.seed & _MASK
        base = [xxhash.xxh3_64_intdigest((document & _MASK).to_bytes(8, "little"), seed) for document in documents]
        begins = np.cumsum(places) - places
        x = (np.arange(1, places.sum() + 1) - np.repeat(begins, places)).astype(np.uint64) * np.uint64(_ODD)
        x += np.repeat(np.array(base, np.uint64), places)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _first_skips(self, outcomes: list[Outcome], keys: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which occurrences have a candidate that is skipped, and the place of the first among its candidates.

        `of` says which outcome each key's occurrence has; by itself, one each.
        """
        offered = Parts.of(list(map(attrgetter("candidates"), outcomes)), np.uint64)
        of = np.arange(len(outcomes)) if of is None else of
        sizes = offered.sizes[of]
        ends = np.cumsum(sizes)
        x = _drawn_all(offered.take(of) ^ np.repeat(keys, sizes))
        skipped = np.flatnonzero(x < np.uint64(int(self.dropout * 2**32)))
        owners = np.searchsorted(ends, skipped, "right")
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        owners, skipped = owners[first], skipped[first]
        return owners, skipped - (ends - sizes)[owners]

    def encode_all(self, texts: list[str], documents: list[int]) -> list[bytes]:
        """Packed ids of each text, with the blank that the vocabulary puts before it."""
        # Nothing here refers to itself; looking for such objects again and again takes longer than the agendas.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts, documents)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str], documents: list[int]) -> list[bytes]:
        cut, stretches = _stretches(texts)
        coded = cut.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        distinct = [stretch.decode("utf-8", "surrogatepass") for stretch in coded.dictionary.to_numpy(zero_copy_only=False)]
        self._learn(set(distinct))
        # From here on occurrences are numbers: of their outcome among those of the distinct stretches.
        parts = list(map(self.known.__getitem__, distinct))
        outcomes = list(chain.from_iterable(parts))
        several = np.fromiter(map(len, parts), np.int64, len(parts))
        of = Parts(np.arange(len(outcomes)), several).take(number)
        ends = np.concatenate([[0], np.cumsum(several[number])])[np.concatenate([[0], np.cumsum(stretches)])]
        keys = self._all_keys(documents, np.diff(ends))
        own_ids = list(map(attrgetter("ids"), outcomes))
        long = np.zeros(len(own_ids), bool)
        if None in own_ids:
            long[:] = [own is None for own in own_ids]
            own_ids = [own or b"" for own in own_ids]
        ids = Parts.of(own_ids, np.uint32)
        begins, sizes, flat = ids.begins[of], ids.sizes[of], [ids.flat]
        # What stands for itself alone comes behind the ids of the distinct ones.
        instead = []
        if long.any():
            at = np.flatnonzero(long[of])
            instead.append((at, Parts.of([self.stretch_ids(outcomes[of[place]].stretch, int(keys[place])) for place in at.tolist()], np.uint32)))
        if self.dropout:
            at = self._first_skips(outcomes, keys, of)[0]
            met, own = np.unique(of[at], return_inverse=True)
            worked = self._work_off([outcomes[place].stretch for place in met.tolist()], keys[at], own)
            instead += [(at[numbers], found) for numbers, found, _ in worked]
        behind = len(ids.flat)
        for at, found in instead:
            begins[at], sizes[at] = behind + found.begins, found.sizes
            flat.append(found.flat)
            behind += len(found.flat)
        every = Parts(np.concatenate(flat), sizes)
        every.begins = begins
        joined = every.take(np.arange(len(of))).tobytes()
        edges = (4 * np.concatenate([[0], np.cumsum(sizes)])[ends]).tolist()
        return list(map(joined.__getitem__, map(slice, edges, edges[1:])))

    def encode(self, text: str, document: int) -> bytes:
        return self.encode_all([text], [document])[0]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, np.uint32).tolist()))
        return text[1:].decode("utf-8", "surrogatepass")

    def decode_all(self, packed: list[bytes]) -> list[str]:
        """`decode` of some texts' ids at once."""
        ids = Parts.of(packed, np.uint32)
        joined = self.spelled.take(ids.flat).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.spelled.sizes[ids.flat])])
        edges = ends[np.concatenate([[0], np.cumsum(ids.sizes)])].tolist()
        return [joined[begin + 1 : end].decode("utf-8", "surrogatepass") for begin, end in zip(edges, edges[1:])]


def encode_pieces(path: str, text: str, key: Column, dropout: float = DROPOUT, seed: int = SEED) -> Column:
    """Packed 32-bit ids of each whole text. Null and empty texts have no ids.

    `key` (a long; null as 0) names the document: rows of one key and text have the same ids. With `dropout` 0 the ids are the vocabulary's own.
    """

    @F.arrow_udf("binary")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pieces = Pieces.of(path)
        pieces.set(dropout, seed)
        for texts, keys in batches:
            out: list[bytes] = []
            for part, some in text_slices([pa.RecordBatch.from_arrays([texts, keys], names=["text", "key"])], "text", TOGETHER, TEXT_BYTES):
                out += pieces.encode_all([text.decode() for text in some], part.column("key").to_pylist())
            yield pa.array(out, pa.binary())
        # What a task has met; common stretches are soon learned again by the next.
        pieces.forget()
        give_back()

    # Evaluated once, also where its ids go into another function.
    encode = encode.asNondeterministic()
    return encode(F.col(text).cast("string"), F.coalesce(key.cast("long"), F.lit(0)))


def decode_pieces(path: str, ids: str) -> Column:
    """The text of packed ids."""

    @F.arrow_udf("string")
    def decode(packed: pa.Array) -> pa.Array:
        pieces, out = Pieces.of(path), []
        for _, some in text_slices([pa.RecordBatch.from_arrays([packed], names=["ids"])], "ids", TOGETHER, ID_BYTES):
            # A long text by itself, in little room.
            out += pieces.decode_all(some) if len(some) > 1 else map(pieces.decode, some)
        return pa.array(out, pa.string())

    return decode(F.col(ids))
