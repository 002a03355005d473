"""Sets of word shingles and their MinHash signatures, for many texts at a time."""

from __future__ import annotations

import numpy as np

#: A-Z in lower case, all other bytes as they are; and which bytes are white space.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, A-Z lower-cased, and the number of words of each text."""
    joined = b"\n".join([*texts, b""]).translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    blank = _SPACE[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    starts = np.flatnonzero(opens)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    solid = np.flatnonzero(~blank)
    firsts = np.searchsorted(solid, starts)
    lengths = np.diff(firsts, append=len(solid))
    powers = np.cumprod(np.full(lengths.max(), _BASE, np.uint64))
    place = np.arange(len(solid)) - np.repeat(firsts, lengths)
    hashes = np.add.reduceat((data[solid].astype(np.uint64) + np.uint64(1)) * powers[place], firsts)
    return mix(hashes ^ lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, all in a row, and their numbers.

    A text with fewer words than a shingle has all its words as its one shingle; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    begins = np.cumsum(counts) - counts
    rolled = hashes.copy()
    for ahead in range(1, words):
        rolled[: len(hashes) - ahead] = mix(rolled[: len(hashes) - ahead] * _STEP + hashes[ahead:])
    out = []
    for begin, count in zip(begins.tolist(), counts.tolist()):
        if count >= words:
            out.append(np.unique(rolled[begin : begin + count - words + 1]))
        elif count:
            one = hashes[begin : begin + 1]
            for other in range(begin + 1, begin + count):
                one = mix(one * _STEP + hashes[other : other + 1])
            # Kept apart from longer shingles by the number of words.
            out.append(mix(one + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signatures(shingles: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures (32-bit values) of sets that all have shingles, one row each."""
    begins = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), coordinates), np.uint32)
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * _BASE)
    for c in range(coordinates):
        hashed = (shingles * (seeds[c] | np.uint64(1)) + seeds[coordinates + c]) >> np.uint64(32)
        out[:, c] = np.minimum.reduceat(hashed, begins) if len(sizes) else 0
    return out


def set_keys(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal sets, in two columns; 0 for empty sets."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((2, len(sizes)), np.uint64)
    np.add.at(out[0], owner, mix(shingles + np.uint64(1)))
    np.add.at(out[1], owner, mix(shingles ^ _STEP))
    return out[0].view(np.int64), out[1].view(np.int64)
