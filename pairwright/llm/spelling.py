"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letters are a set of (letter, which occurrence of it); one inserted or deleted letter changes that set
in one element, one replaced letter in two. The elements are dealt to parts by their hash. Of two sets at
distance d or less, some choice of `parts - d` parts is the same in both, so every choice is a signature and no
pair is missed: words of one length meet under distance two (PARTS[0] parts), words whose lengths differ by one
under distance one (PARTS[1] parts). An edit also leaves one half of the word as it is, so each signature is
posted twice, with the first and with the second half of the letters in their order. Equal signatures are
joined, and every pair is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import text_slices
from pairwright.staging import stage

#: Code points that a word has at least, its occurrences at least, and how many times as frequent its form is.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many (run, document) pairs loses a letter.
THINNED = 31
#: Parts for words of one length and for words whose lengths differ by one.
PARTS = (4, 2)
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Sides of the join: same length; the shorter and the longer of two.
SAME, SHORT, LONG = 0, 1, 2


def thinned(word: str, seed: int) -> str:
    """The run without one letter, where its hash says so; `seed` is the crc32 of what stands before it."""
    h = zlib.crc32(word.encode(), seed)
    if h % THINNED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str, text: str, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of all texts that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch, texts in text_slices(batches, "text"):
            for doc, body in zip(batch.column("doc_id").to_pylist(), texts):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall(body.translate(_LOWER).decode("utf-8", "replace"))).items():
                    word = thinned(word, seed)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield counted()
                    held.clear()
        yield counted()

    read = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def signatures(word: str, elements: dict[tuple[str, int, int], tuple[int, int]]) -> list[tuple[int, int]]:
    """(side, signature) of a word; `elements` remembers the part and the hash of each element."""
    seen: dict[str, int] = {}
    sums = [[0] * parts for parts in PARTS]
    for letter in word:
        nth = seen[letter] = seen.get(letter, 0) + 1
        for own, parts in zip(sums, PARTS):
            found = elements.get((letter, nth, parts))
            if found is None:
                h = xxhash.xxh3_64_intdigest(f"{letter}{nth}/{parts}")
                found = elements[letter, nth, parts] = (h % parts, h)
            own[found[0]] += found[1]
    out = []
    # The side, the length the key is tagged with (that of the shorter word), the parts, and how many may differ.
    length = len(word)
    for side, tag, own, differ in ((SAME, length, sums[0], 2), (SHORT, length, sums[1], 1), (LONG, length - 1, sums[1], 1)):
        middle = tag // 2
        halves = (f"<{word[:middle]}", f">{word[length - (tag - middle):]}")
        for kept in combinations(range(len(own)), len(own) - differ):
            chosen = ",".join([str(own[part]) for part in kept])
            for half in halves:
                key = xxhash.xxh3_64_intdigest(f"{differ},{tag},{kept},{chosen}{half}")
                out.append((side, key - (1 << 63)))
    return out


def _postings(words: DataFrame) -> DataFrame:
    """(side, key, word, n): every word under each of its signatures."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements: dict[tuple[str, int, int], tuple[int, int]] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                signed = [signatures(word, elements) for word in part.column("word").to_pylist()]
                flat = [one for own in signed for one in own]
                rows = pa.array([row for row, own in enumerate(signed) for _ in own], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([side for side, _ in flat], pa.int8()),
                        pa.array([key for _, key in flat], pa.int64()),
                        part.column("word").take(rows),
                        part.column("n").take(rows),
                    ],
                    names=["side", "key", "word", "n"],
                )

    return words.mapInArrow(post, "side byte, key long, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): all pairs of `words` (word, n) at one edit, both ways round."""
    posted = stage(_postings(words), "signatures")
    left = posted.where(F.col("side") != LONG)
    right = posted.where(F.col("side") != SHORT).select(
        "key", F.col("side").alias("other_side"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    # Code points, not bytes; the bound ends the comparison early.
    edited = F.levenshtein("word", "other", 1) == 1
    once = (F.col("side") == SHORT) | (F.col("word") < F.col("other"))
    same_side = (F.col("side") == SAME) == (F.col("other_side") == SAME)
    met = (
        # Both sides lie written, so a list that many words share is dealt to several tasks.
        left.join(right.hint("merge"), "key")
        .where(same_side & once & edited)
        .groupBy("word", "other")
        .agg(F.any_value("n").alias("n"), F.any_value("other_n").alias("other_n"))
    )
    both = F.array(
        F.struct("word", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    return met.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the last word of its chain.

    Each form is at least RATIO times as frequent, so chains are short; every round halves what is left.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        # Written on both sides, so that a form with very many variants is dealt to several tasks.
        joined = now.join(ahead.hint("merge"), "root", "left")
        after = stage(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the words of all texts and what they are variants of.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; a run whose crc32 behind
    its doc_id and a colon is divisible by THINNED loses one letter. Two words are near if one inserted, deleted or
    replaced code point makes one of the other. A word's form is its near word with the largest n (of equals the
    first in code-point order), if that is at least `ratio` times its own; its root is the end of the chain of forms.

    Null and empty texts have no words, a null doc_id reads as the empty text, and repeated rows count each. Without
    words there are no rows. Other columns are not read.
    """
    words = stage(word_counts(docs, doc_id, text, min_length, min_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = stage(
        words.join(near.hint("merge"), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
