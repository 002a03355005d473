"""Suffix sorting by induction, out of queues that lie on disk, with common-prefix values.

A text is an array of symbols: contexts one after the other, each ended by a 0. Its suffixes are sorted by
induction: the suffixes at the left ends of rising runs (the seeds) are named, the string of their names is
sorted first, by the same means, and all others follow. A suffix whose successor is the next smallest gets
the next place among those with its first symbol; so every symbol has a queue of (position, common prefix)
tuples that is filled in order, and all queues together are a priority queue whose smallest tuples come out
in batches. One pass upwards places the falling suffixes, one downwards the rising ones. The common prefix
of neighbours is carried along: one more than the least value between the two that induced them.

Queues spill to one unnamed scratch file, and the text is mapped to memory from another, so that a shard may
be far larger than memory. The scratch files vanish with the task.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Common prefixes are told apart up to this length.
MOST = 100
#: Tuples that queues hold in memory before they spill.
HELD = 1 << 22
#: Strings of names up to this length are sorted in memory by doubling, longer ones by induction again.
SHORT = 1 << 21


class Scratch:
    """A scratch file without a name: arrays are appended and read back."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.end = 0

    def put(self, values: np.ndarray) -> tuple[int, int, np.dtype]:
        self.file.seek(self.end)
        self.file.write(np.ascontiguousarray(values).tobytes())
        place = (self.end, len(values), values.dtype)
        self.end += values.nbytes
        return place

    def get(self, place: tuple[int, int, np.dtype]) -> np.ndarray:
        at, size, kind = place
        self.file.seek(at)
        return np.frombuffer(self.file.read(size * kind.itemsize), kind)

    def close(self) -> None:
        self.file.close()


def mapped(parts: Iterator[np.ndarray], kind: type) -> np.ndarray:
    """Arrays in a row, on disk and mapped to memory."""
    file = tempfile.TemporaryFile()  # noqa: SIM115
    size = 0
    for part in parts:
        file.write(np.ascontiguousarray(part, kind).tobytes())
        size += len(part)
    file.flush()
    return np.memmap(file, kind, "r+", shape=(size,)) if size else np.zeros(0, kind)


class Queues:
    """A queue of (position, common prefix) batches per symbol; batches beyond `held` tuples lie in the scratch file."""

    def __init__(self, symbols: int, scratch: Scratch, held: int = HELD) -> None:
        self.waiting: list[list] = [[] for _ in range(symbols)]
        self.scratch, self.held, self.size = scratch, held, 0

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.waiting[symbol].append((positions, prefixes))
        self.size += len(positions)
        if self.size > self.held:
            for queue in self.waiting:
                for at, (p, q) in enumerate(queue):
                    if isinstance(p, np.ndarray):
                        queue[at] = (self.scratch.put(p), self.scratch.put(q))
            self.size = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a symbol in the order they came."""
        batches = [
            (p, q) if isinstance(p, np.ndarray) else (self.scratch.get(p), self.scratch.get(q)) for p, q in self.waiting[symbol]
        ]
        self.waiting[symbol] = []
        if not batches:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in batches]), np.concatenate([q for _, q in batches])


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes rise (are smaller than their successor; those at a 0 do), and how long the run of the first symbol is."""
    size = len(text)
    breaks = np.append(np.flatnonzero(text[1:] != text[:-1]), size - 1)
    run_end = np.repeat(breaks, np.diff(breaks, prepend=-1))
    following = np.minimum(run_end + 1, size - 1)
    rises = (text[following] > text) | (text == 0)
    return rises, run_end - np.arange(size) + 1


def _seeds(rises: np.ndarray) -> np.ndarray:
    """Rising suffixes that follow a falling one."""
    return np.flatnonzero(rises[1:] & ~rises[:-1]) + 1


def _names(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Names of the stretches from each seed to the next, in their order: equal stretches have equal names, that of a 0 is 0.

    A stretch that goes on where another has ended is the smaller one, as it falls where the other rises.
    """
    wide = np.uint64(16 if text.dtype == np.uint16 else 32)
    per_word = 64 // int(wide)
    pad = np.uint64((1 << int(wide)) - 1)
    lengths = np.append(np.diff(seeds) + 1, 1)
    lengths[text[seeds] == 0] = 1
    rank = np.zeros(len(seeds), np.int64)
    active = np.arange(len(seeds))
    done = 0
    while len(active):
        word = np.zeros(len(active), np.uint64)
        for offset in range(done, done + per_word):
            inside = lengths[active] > offset
            at = np.minimum(seeds[active] + offset, len(text) - 1)
            word = (word << wide) | np.where(inside, text[at].astype(np.uint64), pad)
        order = np.lexsort((word, rank[active])) if done else np.argsort(word)
        active, word = active[order], word[order]
        old = rank[active]
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        fresh = group.copy()
        fresh[1:] |= word[1:] != word[:-1]
        firsts = np.flatnonzero(fresh)
        # A rank is that of the first stretch of its group plus what lies before within the old group.
        begin = np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        rank[active] = old + np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0)) - begin
        done += per_word
        sizes = np.diff(firsts, append=len(active))
        tied = np.repeat(sizes > 1, sizes) & (lengths[active] > done)
        # Within a tied group all have the same symbols; those that ended are its last and need no more comparing.
        active = active[tied]
    return np.unique(rank, return_inverse=True)[1].astype(np.uint32)


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """All suffixes in order; beyond a 0 nothing is compared."""
    size, step = len(text), 1
    key = text.astype(np.uint64)
    ended = text == 0
    # A suffix's rank is the number of suffixes that are smaller by what has been compared so far.
    order = np.argsort(key)
    held = key[order]
    rank = np.empty(size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, held[1:] != held[:-1]), np.arange(size), 0))
    tied = np.append(True, held[1:] == held[:-1]) & (np.arange(size) > 0)
    # Places in the order whose suffixes are still equal to a neighbour.
    open_places = np.flatnonzero(tied | np.append(tied[1:], False))
    while len(open_places):
        own = order[open_places]
        # One that has reached its 0 is as sorted as it gets: it takes the rank 0 for what lies ahead.
        ahead = np.where(ended[own], 0, rank[np.minimum(own + step, size - 1)] + 1)
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_places] = own
        old = (key >> np.uint64(32)).astype(np.int64)
        group = np.append(True, old[1:] != old[:-1])
        fresh = np.append(True, key[1:] != key[:-1])
        index = np.arange(len(own))
        begin = np.maximum.accumulate(np.where(group, index, 0))
        new = old + np.maximum.accumulate(np.where(fresh, index, 0)) - begin
        done = ended[own]
        reach = done | ended[np.minimum(own + step, size - 1)]
        rank[own] = new
        ended[own] = reach
        tied = ~fresh
        several = tied | np.append(tied[1:], False)
        open_places = open_places[several & ~done]
        step *= 2
    return order


class _Runs:
    """A priority queue of numbers for large alphabets: a heap, and sorted runs of it in the scratch file."""

    def __init__(self, scratch: Scratch, held: int) -> None:
        self.heap: list[int] = []
        self.runs: list[tuple[int, Iterator[int]]] = []
        self.scratch, self.held, self.number = scratch, held, 0

    def _read(self, places: list) -> Iterator[int]:
        for high, low in places:
            for a, b in zip(self.scratch.get(high).tolist(), self.scratch.get(low).tolist()):
                yield a << 64 | b

    def push(self, value: int) -> None:
        heapq.heappush(self.heap, value)
        if len(self.heap) > self.held:
            run = sorted(self.heap)
            places = []
            for at in range(0, len(run), 1 << 14):
                own = run[at : at + (1 << 14)]
                places.append(
                    (self.scratch.put(np.array([v >> 64 for v in own], np.uint64)), self.scratch.put(np.array([v & (1 << 64) - 1 for v in own], np.uint64)))
                )
            values = self._read(places)
            heapq.heappush(self.runs, (next(values), self.number, values))
            self.number += 1
            self.heap = []

    def least(self) -> int | None:
        if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
            return self.heap[0]
        return self.runs[0][0] if self.runs else None

    def pop(self) -> int:
        if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        value, number, values = self.runs[0]
        following = next(values, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, number, values))
        return value


def _induce_order(text: np.ndarray, rises: np.ndarray, seeds: np.ndarray, scratch: Scratch, held: int) -> np.ndarray:
    """All suffixes of a string of names in order, induced from its sorted seeds through a queue of (symbol, number, position)."""
    symbols, up = text.tolist(), rises.tolist()
    most = int(text.max())
    falling = _Runs(scratch, held)
    out: list[int] = []
    placed = np.zeros(len(symbols), np.int64)
    filled = 0

    def flush() -> None:
        nonlocal filled
        placed[filled : filled + len(out)] = out
        filled += len(out)
        out.clear()

    number = 0
    for seed in [*seeds.tolist(), None]:
        limit = (symbols[seed] + 1) << 96 if seed is not None else (most + 2) << 96
        while (least := falling.least()) is not None and least < limit:
            at = falling.pop() & 0xFFFFFFFFFFFF
            out.append(at)
            if at and not up[at - 1]:
                falling.push(symbols[at - 1] << 96 | number << 48 | at - 1)
                number += 1
        if seed is not None and seed and not up[seed - 1]:
            falling.push(symbols[seed - 1] << 96 | number << 48 | seed - 1)
            number += 1
    flush()
    down = placed[:filled][::-1]
    final = np.empty(len(symbols), np.int64)
    end = len(symbols)
    rising = _Runs(scratch, held)
    number = 0
    # Downwards: larger symbols come first, and of one symbol the rising suffixes before the falling ones.
    for fall in [*down.tolist(), None]:
        limit = (most - symbols[fall] + 1) << 96 if fall is not None else (most + 2) << 96
        while (least := rising.least()) is not None and least < limit:
            at = rising.pop() & 0xFFFFFFFFFFFF
            end -= 1
            final[end] = at
            if at and up[at - 1] and symbols[at - 1]:
                rising.push((most - symbols[at - 1]) << 96 | number << 48 | at - 1)
                number += 1
        if fall is not None:
            end -= 1
            final[end] = fall
            if fall and up[fall - 1] and symbols[fall - 1]:
                rising.push((most - symbols[fall - 1]) << 96 | number << 48 | fall - 1)
                number += 1
    # The zeros, which nothing induces.
    final[:end] = np.flatnonzero(text == 0)
    return final


def _order(text: np.ndarray, scratch: Scratch, short: int, held: int) -> np.ndarray:
    """All suffixes of a string of names in order, by recursion."""
    if len(text) <= short:
        return _by_doubling(text)
    rises, _ = _types(text)
    seeds = _seeds(rises)
    if text[0] == 0:
        seeds = np.append(0, seeds)
    if not len(seeds):
        return _by_doubling(text)
    ranked = seeds[_order(_names(text, seeds), scratch, short, held)]
    return _induce_order(text, rises, ranked, scratch, held)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of two suffixes each, up to `most`; a 0 is never common."""
    out = np.zeros(len(a), np.uint8)
    active = np.arange(len(a))
    for step in range(most):
        x = text[np.minimum(a[active] + step, len(text) - 1)]
        same = (x == text[np.minimum(b[active] + step, len(text) - 1)]) & (x != 0)
        active = active[same]
        if not len(active):
            break
        out[active] += 1
    return out


class _Pass:
    """One sweep over the symbols: batches of a symbol's suffixes go in, what they induce is pushed with common prefixes."""

    def __init__(self, text: np.ndarray, take: np.ndarray, queues: Queues, most: int, symbols: int) -> None:
        self.text, self.take, self.queues, self.most = text, take, queues, most
        self.pending = np.zeros(symbols, np.uint8)

    def symbol(self) -> None:
        """A new symbol begins: what induced earlier pushes began with another one and shares nothing with what comes."""
        self.pending[:] = 0

    def batch(self, positions: np.ndarray, prefixes: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Push what a batch induces; what begins with the symbol `own` itself is returned instead, as the next batch."""
        if not len(positions):
            return positions, prefixes
        before = positions - 1
        at = np.flatnonzero((positions > 0) & self.take[before])
        first = self.text[before[at]]
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        opens = np.ones(len(at), bool)
        opens[1:] = first[1:] != first[:-1]
        # Least prefix value since the last push of the same symbol: within the batch, or from its begin on.
        low = np.empty(len(at), np.uint8)
        so_far = np.minimum.accumulate(prefixes)
        low[opens] = np.minimum(self.pending[first[opens]], so_far[at[opens]])
        later = np.flatnonzero(~opens)
        if len(later):
            spans = np.stack([at[later - 1] + 1, at[later] + 1], 1).ravel()
            low[later] = np.minimum.reduceat(np.append(prefixes, np.uint8(255)), spans)[::2]
        ends = np.append(np.flatnonzero(opens)[1:], len(at)) - 1 if len(at) else np.zeros(0, np.int64)
        self.pending = np.minimum(self.pending, so_far[-1])
        if len(ends):
            tails = np.minimum.accumulate(prefixes[::-1])[::-1]
            self.pending[first[ends]] = np.append(tails, np.uint8(255))[at[ends] + 1]
        carried = np.minimum(low, self.most - 1) + np.uint8(1)
        next_batch = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        for begin, end in zip(np.flatnonzero(opens).tolist(), ends.tolist()):
            part = slice(begin, end + 1)
            symbol = int(first[begin])
            if symbol == own:
                next_batch = before[at[part]], carried[part]
            else:
                self.queues.push(symbol, before[at[part]], carried[part])
        return next_batch


def sorted_suffixes(
    text: np.ndarray, most: int = MOST, short: int = SHORT, held: int = HELD
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (positions, common prefixes) of a text of 16-bit symbols, in descending order of the suffixes.

    The text ends with a 0. A common prefix is that with the suffix just before (0 at a new first symbol), up
    to `most`, and never counts a 0. Suffixes that are equal up to their 0 come in any order.
    """
    if not len(text):
        return
    scratch = Scratch()
    symbols = int(text.max()) + 1
    rises, runs = _types(text)
    runs = np.minimum(runs, most).astype(np.uint8)
    seeds = _seeds(rises)
    if text[0] == 0:
        seeds = np.append(0, seeds)
    seeds = seeds[_order(_names(text, seeds), scratch, short, held)]
    seed_prefix = np.append(np.zeros(1, np.uint8), _common(text, seeds[:-1], seeds[1:], most))
    edges = np.searchsorted(text[seeds], np.arange(symbols + 1))
    upwards = _Pass(text, ~rises, Queues(symbols, scratch, held), most, symbols)
    falling: list[tuple] = []
    for symbol in range(symbols):
        upwards.symbol()
        done = []
        batch = upwards.queues.pop(symbol)
        while len(batch[0]):
            done.append(batch)
            batch = upwards.batch(*batch, symbol)
        positions = np.concatenate([p for p, _ in done]) if done else np.zeros(0, np.int64)
        prefixes = np.concatenate([q for _, q in done]) if done else np.zeros(0, np.uint8)
        if len(prefixes):
            prefixes[0] = 0
        falling.append((scratch.put(positions), scratch.put(prefixes)))
        own = slice(edges[symbol], edges[symbol + 1])
        rising, rising_prefix = seeds[own], seed_prefix[own].copy()
        if len(rising):
            # Where falling and rising suffixes of one symbol meet, its shorter run is all they share.
            rising_prefix[0] = min(runs[positions[-1]], runs[rising[0]]) if len(positions) and symbol else 0
            upwards.batch(rising, rising_prefix, -1)
    downwards = _Pass(text, rises & (text != 0), Queues(symbols, scratch, held), most, symbols)
    for symbol in range(symbols - 1, 0, -1):
        downwards.symbol()
        batch = downwards.queues.pop(symbol)
        if len(batch[1]):
            batch[1][0] = 0
        last = None
        while len(batch[0]):
            yield batch
            last = batch[0][-1]
            batch = downwards.batch(*batch, symbol)
        positions, prefixes = (scratch.get(place) for place in falling[symbol])
        if len(positions):
            # In descending order a value belongs to the pair from the other side.
            turned = np.append(prefixes[1:], np.uint8(0))[::-1].copy()
            turned[0] = min(runs[last], runs[positions[-1]]) if last is not None else 0
            yield positions[::-1], turned
            downwards.batch(positions[::-1].copy(), turned, -1)
    scratch.close()
