"""Token ids of whole texts by a public word-level BPE, worked out once per distinct word.

The tokenizer never joins characters across ASCII white space, so the ids of a text are those of its
words in a row. Arrow cuts some texts into words and numbers the distinct ones; only those are looked up
among the words a worker has met. New ones are cut into a run of plain letters and the marks after it, what
several words share is one, and only what is new then goes to the tokenizer, many at a time.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairwright.llm.tables import give_back

#: Words a worker remembers at most; beyond, those that were met in few calls go.
REMEMBERED = 250_000
#: Words it carries on to its next task: those met in most calls, so the common ones.
CARRIED = 120_000
#: New words that go to the tokenizer in one call.
TOGETHER = 100
#: Texts, and bytes of them, that are encoded at a time; of these, bytes whose ids are put together at a time.
TEXTS, TEXT_BYTES, OUT_BYTES = 8192, 1 << 22, 1 << 20
_TAIL = ".,!?;:"
#: Letters that the tokenizer's normalization makes small and leaves as they are else, and that are one run to it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_workers: dict[str, WordIds] = {}


def _gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parts of `flat` in a row."""
    at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


class _Ids:
    """Ids of some strings: `flat[begins[at] : begins[at] + sizes[at]]` of the one at a place."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes, self.begins = flat, sizes, np.cumsum(sizes) - sizes

    def take(self, at: np.ndarray) -> _Ids:
        return _Ids(_gathered(self.flat, self.begins[at], self.sizes[at]), self.sizes[at])

    def then(self, other: _Ids) -> _Ids:
        return _Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word; -1 if it is not there."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class WordIds:
    def __init__(self, path: str) -> None:
        # Tasks run side by side already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same model without normalization and patterns, for words of plain letters, which both leave alone.
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        by_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        held |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, by_bytes]}}
        self.bare = Tokenizer.from_str(json.dumps(held))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # Words met often, their ids, and the calls that each was met in.
        self.words = pa.array([], pa.binary())
        self.ids = _Ids(np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.calls = np.zeros(0, np.int64)

    @property
    def known(self) -> list[bytes]:
        return self.words.to_pylist()

    def _alone(self, words: pa.Array) -> list[np.ndarray]:
        """The ids of texts that each stand by themselves."""
        texts = [word.decode("utf-8", "replace") for word in words.to_numpy(zero_copy_only=False)]
        return [
            np.array(found.ids, np.uint32)
            for at in range(0, len(texts), TOGETHER)
            for found in self.tokenizer.encode_batch_fast(texts[at : at + TOGETHER], add_special_tokens=False)
        ]

    def _runs(self, words: pa.Array) -> Iterator[_Ids]:
        """The ids of words of plain small letters: one run of tokens each, whose last token ends the word."""
        edges = np.append(np.arange(0, len(words), TOGETHER, np.int32), np.int32(len(words)))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words.view(pa.string()))
        for line, begin, end in zip(pc.binary_join(lists, " ").to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == end - begin and stops[-1] == len(ids):
                yield _Ids(ids, np.diff(stops, prepend=0))
            else:
                yield from self._each(words.slice(begin, end - begin))

    def _each(self, words: pa.Array) -> Iterator[_Ids]:
        if own := self._alone(words):
            yield _Ids(np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own)))

    def _learned(self, words: pa.Array) -> _Ids:
        """The ids of some distinct words."""
        texts = words.view(pa.string())  # of which only those that are plain letters and marks are read as such
        heads = pc.ascii_rtrim(texts, characters=_TAIL)
        plain = pc.match_substring_regex(heads, f"^[{_LETTERS}]+$")
        own = pc.utf8_lower(heads.filter(plain))
        # Marks after a run of letters stand alone.
        tailed = pc.and_(plain, pc.not_equal(pc.binary_length(texts), pc.binary_length(heads)))
        tails = pc.replace_substring_regex(texts.filter(tailed), f"^[{_LETTERS}]+", "")
        odd = texts.filter(pc.invert(plain))
        coded = [part.view(pa.binary()).dictionary_encode() for part in (own, pa.concat_arrays([tails, odd]))]
        runs, others = (part.dictionary for part in coded)
        # A run of letters is a word, too, which may be known.
        at = _places(runs, self.words)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.words) + np.arange(len(new))
        # All that words are put together from; nothing comes last.
        every = [self.ids, *self._runs(runs.take(pa.array(new))), *self._each(others), _Ids(np.zeros(0, np.uint32), np.zeros(1, np.int64))]
        store = _Ids(np.concatenate([part.flat for part in every]), np.concatenate([part.sizes for part in every]))
        nothing, first_other = len(store.sizes) - 1, len(self.words) + len(new)
        number = [part.indices.to_numpy(zero_copy_only=False) for part in coded]
        is_plain, is_tailed = (mask.to_numpy(zero_copy_only=False) for mask in (plain, tailed))
        pieces = np.full((len(words), 2), nothing, np.int64)
        pieces[is_plain, 0] = at[number[0]]
        pieces[is_tailed, 1] = first_other + number[1][: len(tails)]
        pieces[~is_plain, 0] = first_other + number[1][len(tails) :]
        both = store.sizes[pieces]
        return _Ids(_gathered(store.flat, store.begins[pieces].ravel(), both.ravel()), both.sum(1))

    def _found(self, words: pa.Array, often: np.ndarray) -> _Ids:
        """The ids of distinct words. Only those met often are remembered: most words of a corpus occur once."""
        if len(self.words) > REMEMBERED:
            self._keep(REMEMBERED // 2)
        at = _places(words, self.words)
        self.calls[at[at >= 0]] += 1
        new = np.flatnonzero(at < 0)
        learned = self._learned(words.take(pa.array(new)))
        at[new] = len(self.words) + np.arange(len(new))
        found = self.ids.then(learned).take(at)
        kept = np.flatnonzero(often[new])
        self.words = pa.concat_arrays([self.words, words.take(pa.array(new[kept]))])
        self.ids = self.ids.then(learned.take(kept))
        self.calls = np.concatenate([self.calls, np.ones(len(kept), np.int64)])
        return found

    def _keep(self, number: int) -> None:
        """Forget all but the words met in most calls, of these the first ones."""
        if len(self.words) > number:
            at = np.sort(np.argsort(-self.calls, kind="stable")[:number])
            self.words, self.ids, self.calls = self.words.take(pa.array(at)), self.ids.take(at), self.calls[at]

    def forget(self) -> None:
        """Most of what a task has met."""
        self._keep(CARRIED)
        give_back()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        # Only ASCII white space is looked at, so bytes that are no UTF-8 stay as they are.
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = cut.values.dictionary_encode()
        offsets = cut.offsets.to_numpy()
        number = coded.indices.to_numpy(zero_copy_only=False)
        del cut
        ids = self._found(coded.dictionary.view(pa.binary()), np.bincount(number) > 1)
        out: list[bytes] = []
        # Ids take several times the room of their text meanwhile, so they are put together for a few texts at a time.
        held = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        edges = np.unique(np.searchsorted(held, np.arange(0, held[-1] + 1 if len(held) else 0, OUT_BYTES), "left"))
        for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(texts)]):
            own = number[offsets[begin] : offsets[end]]
            sizes = ids.sizes[own]
            packed = _gathered(ids.flat, ids.begins[own], sizes).tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            places = (4 * ends[offsets[begin : end + 1] - offsets[begin]]).tolist()
            out += map(packed.__getitem__, map(slice, places, places[1:]))
        return out


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer for the file; kept from task to task."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]
