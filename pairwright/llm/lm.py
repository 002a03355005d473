"""Cross-entropy difference of two matched n-gram models.

Target and background are bigram models over one vocabulary, that of a public tokenizer. The background is
counted over all documents, the target over those of a chosen set. Counts are exact and lie in a written
table with a row per distinct bigram, which grows with the corpus. Its most frequent bigrams, `FREQUENT` at
most, are broadcast with the counts of single tokens; the others of each document are counted per document
and joined to the table, so that no key of that join is hot. The background's counts are scaled to the
target's number of tokens, so that smoothing weighs the same in both. A document's score is the mean over
its tokens of target loss minus background loss; the lower, the more it looks like the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import text_slices
from pairwright.llm.words import TEXT_BYTES, TEXTS, word_ids
from pairwright.staging import stage

#: Bigrams that tasks share instead of joining them.
FREQUENT = 1 << 20
#: Pseudo-counts: of a context's bigrams, given to its unigrams, and of each token of the vocabulary.
CONTEXT_WEIGHT, TOKEN_WEIGHT = 50.0, 0.5
#: Tokens a task handles at a time.
TOKENS = 1 << 20


def token_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` (a number of its own), `doc_id` and `ids` (32-bit, packed; ids of a null or empty text: none) of every whole text, written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for some, texts in text_slices(batches, "text", TEXTS, TEXT_BYTES):
            ids = pa.array(words.encode(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), ids], names=["row", "doc_id", "ids"])
        words.forget()

    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    return stage(read.mapInArrow(encode, "row long, doc_id long, ids binary"), "tokens")


def cell_of(first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each bigram."""
    x = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(cells)).astype(np.int64)


def key_of(first: np.ndarray, second: np.ndarray, cells: int | None = None) -> np.ndarray:
    """What bigrams are counted by: both tokens, or a cell if `cells` are asked for."""
    if cells:
        return cell_of(first, second, cells)
    return (first.astype(np.int64) << 32) | second.astype(np.int64)


def _bigrams(ids: list[bytes], start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second tokens of all bigrams of some texts, each within a start and an end, and where each text begins."""
    edge = np.array([end, start], np.uint32).tobytes()
    run = np.frombuffer(edge[4:] + edge.join(ids) + edge[:4], np.uint32)
    sizes = np.array([len(i) // 4 + 2 for i in ids])
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(run), bool)
    inside[begins + sizes - 1] = False  # an end token opens no bigram
    at = np.flatnonzero(inside)
    return run[at], run[at + 1], begins - np.arange(len(ids))


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """Rows, doc_ids and ids of about `TOKENS` tokens at a time."""
    rows, docs, held, size = [], [], [], 0
    for batch in batches:
        for row, doc, ids in zip(*(batch.column(name).to_pylist() for name in ("row", "doc_id", "ids"))):
            rows.append(row)
            docs.append(doc)
            held.append(ids)
            size += len(ids) // 4
            if size >= TOKENS:
                yield rows, docs, held
                rows, docs, held, size = [], [], [], 0
    if docs:
        yield rows, docs, held


def count_ngrams(tokens: DataFrame, vocabulary: int, start: int, end: int, cells: int | None = None) -> DataFrame:
    """`key`, `n` of parts of every partition: bigrams at their key, contexts at -1 - token, next tokens at -1 - `vocabulary` - token."""

    def counted(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(n[own].astype(np.int64))], names=["key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = np.zeros(2 * vocabulary, np.int64)
        for _, _, ids in _large(batches):
            first, second, _ = _bigrams(ids, start, end)
            single[:vocabulary] += np.bincount(first, minlength=vocabulary)
            single[vocabulary:] += np.bincount(second, minlength=vocabulary)
            yield from counted(*np.unique(key_of(first, second, cells), return_counts=True))
        some = np.flatnonzero(single)
        yield from counted(-1 - some, single[some])

    return tokens.select("row", "doc_id", "ids").mapInArrow(count, "key long, n long")


def ngram_table(tokens: DataFrame, target_ids: DataFrame, vocabulary: int, start: int, end: int, cells: int | None = None) -> DataFrame:
    """`key`, `target`, `background`: exact counts of both models, a row per distinct key of `count_ngrams`, written once."""
    chosen = tokens.join(target_ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    zero = F.lit(0).cast("long")
    target = count_ngrams(chosen, vocabulary, start, end, cells).select("key", F.col("n").alias("target"), zero.alias("background"))
    background = count_ngrams(tokens, vocabulary, start, end, cells).select("key", zero.alias("target"), F.col("n").alias("background"))
    summed = target.unionByName(background).groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    return stage(summed, "ngrams")


@dataclass
class NgramModel:
    """Scale of a model's counts; counts of contexts and smoothed next-token shares by token, both scaled."""

    scale: float
    contexts: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, vocabulary: int, scale: float) -> NgramModel:
        seen = counts[vocabulary:] * scale
        return cls(scale, counts[:vocabulary] * scale, (seen + TOKEN_WEIGHT) / (seen.sum() + TOKEN_WEIGHT * vocabulary))

    def losses(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log p(second | first) of each bigram that was counted `n` times."""
        # Bigrams that share a cell cannot make one more frequent than its context.
        known = np.minimum(n * self.scale, self.contexts[first])
        return np.log(self.contexts[first] + CONTEXT_WEIGHT) - np.log(known + CONTEXT_WEIGHT * self.shares[second])


def fit_models(table: DataFrame, vocabulary: int) -> tuple[NgramModel, NgramModel]:
    """Target and background model. The driver gets two rows per token of the vocabulary at most.

    Without target documents the target is smoothing alone.
    """
    single = table.where("key < 0").toArrow()
    counts = np.zeros((2, 2 * vocabulary))
    at = -1 - single["key"].to_numpy()
    counts[0, at], counts[1, at] = single["target"].to_numpy(), single["background"].to_numpy()
    sizes = counts[:, :vocabulary].sum(1)
    scale = sizes[0] / sizes[1] if sizes.all() else 1.0
    return NgramModel.of(counts[0], vocabulary, 1.0), NgramModel.of(counts[1], vocabulary, scale)


def _rare_below(table: DataFrame, most: int) -> int:
    """The least power of two that at most `most` bigrams are as frequent as. The driver sees a row per power."""
    power = F.floor(F.log2("background")).cast("int")
    held = {r["power"]: r["n"] for r in table.where("key >= 0").groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    below, sum_n = max(held, default=0) + 1, 0
    while below > 0 and sum_n + held.get(below - 1, 0) <= most:
        below -= 1
        sum_n += held.get(below, 0)
    return 1 << below


def score_documents(
    docs: DataFrame, target_ids: DataFrame, path: str, start: int, end: int, doc_id: str = "doc_id", text: str = "text", cells: int | None = None
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_tokens`, `target_loss`, `background_loss`, `difference`.

    Losses are means over a text's tokens and its end. A null or empty text has the end alone. Documents that
    repeat a doc_id count and score each; a null doc_id is never a target. Other columns are ignored.
    Bigrams are counted exactly; with `cells`, those that share one of so many hashed cells blur each other.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    tokens = token_table(docs, path, doc_id, text)
    context = tokens.sparkSession.sparkContext
    table = ngram_table(tokens, target_ids, vocabulary, start, end, cells)
    models = context.broadcast(fit_models(table, vocabulary))
    # All cells are shared; a bound on them is what asking for cells means.
    rare = 1 if cells else _rare_below(table, FREQUENT)
    often = table.where((F.col("key") >= 0) & (F.col("background") >= rare)).toArrow().sort_by("key")
    frequent = context.broadcast(tuple(often[name].to_numpy() for name in ("key", "target", "background")))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, *counts = (column.to_numpy() for column in batch.columns)
            losses = [pa.array(m.losses(key >> 32, key & 0xFFFFFFFF, n)) for m, n in zip(models.value, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *losses], names=["key", "target_loss", "background_loss"])

    own_type = pa.struct([("doc_id", pa.int64()), ("target", pa.float64()), ("background", pa.float64())])
    names = ["key", "row", "n", "own"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with what its frequent bigrams lose, and one per text and other bigram."""
        keys, *counts = frequent.value
        for row_of, doc_of, ids in _large(batches):
            first, second, begins = _bigrams(ids, start, end)
            rows, key = np.array(row_of, np.int64), key_of(first, second, cells)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            met = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            sums = []
            for model, n in zip(models.value, counts):
                losses = np.zeros(len(key))
                losses[met] = model.losses(first[met], second[met], n[at[met]])
                sums.append(pa.array(np.add.reduceat(losses, begins)))
            own = pa.StructArray.from_arrays([pa.array(doc_of, pa.int64()), *sums], fields=list(own_type))
            n = np.array([len(i) // 4 for i in ids], np.int64)
            # Keys of their own: these rows meet nothing and are dealt evenly.
            yield pa.RecordBatch.from_arrays([pa.array(-1 - rows), pa.array(rows), pa.array(n), own], names=names)
            rest = np.flatnonzero(~met)
            if not len(rest):
                continue
            key, text_of = key[rest], np.searchsorted(begins, rest, "right") - 1
            order = np.lexsort((key, text_of))
            key, text_of = key[order], text_of[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text_of[1:] != text_of[:-1])]))
            times = np.diff(new, append=len(key))
            key, row = key[new], rows[text_of[new]]
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                columns = [pa.array(key[part]), pa.array(row[part]), pa.array(times[part])]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), own_type)], names=names)

    scored = tokens.mapInArrow(score, "key long, row long, n long, own struct<doc_id: long, target: double, background: double>")
    rated = table.where((F.col("key") >= 0) & (F.col("background") < rare)).select("key", "target", "background")
    rated = rated.mapInArrow(rate, "key long, target_loss double, background_loss double")
    summed = (
        scored.join(rated.hint("merge"), "key", "left")
        .groupBy("row")
        .agg(
            F.max("own.doc_id").alias("doc_id"),
            F.max(F.when(F.col("key") < 0, F.col("n"))).alias("n_tokens"),
            *(F.sum(F.coalesce(f"own.{m}", F.col("n") * F.col(f"{m}_loss"))).alias(m) for m in ("target", "background")),
        )
    )
    means = [(F.col(m) / (F.col("n_tokens") + 1)).alias(f"{m}_loss") for m in ("target", "background")]
    return summed.select("doc_id", "n_tokens", *means).withColumn("difference", F.col("target_loss") - F.col("background_loss"))
