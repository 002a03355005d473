"""A quality classifier out of compression: text that a dictionary of good text shortens more is good.

Two zstandard dictionaries are built from labelled text of either class. A text is compressed with both, in
pieces short enough for the dictionary to matter; the difference of the two sizes over the larger one, with
both sizes per byte, goes into a logistic curve that is fitted on labelled rows the dictionaries have not
seen. Labels serve the fit alone.

What the driver sees is a bounded sample: of each class at most `per_class` labelled texts of at most
`sample_bytes` bytes, chosen by hash. Scoring reads every text in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import hashed_sample, text_slices

PER_CLASS = 3_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 112_640
PIECE_BYTES = 2_048
LEVEL = 3
THRESHOLD = 0.7
#: Texts that a task scores at a time.
TOGETHER = 128
#: Compressed bytes per byte count up to here; very short texts are longer when compressed.
MOST_PER_BYTE = 1.25


@dataclass
class QualityModel:
    """Dictionaries of either class, the curve's weights, and the share of good rows where there is nothing to fit."""

    good: bytes
    bad: bytes
    weights: np.ndarray | None
    share: float


def _pieces(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE_BYTES] for at in range(0, len(text), PIECE_BYTES)] or [b""]


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [piece for text in texts for piece in _pieces(text) if piece]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to choose from: all of it
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


class _Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.compressors = []
        for own in (good, bad):
            own_dict = zstandard.ZstdCompressionDict(own)
            own_dict.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own_dict, compression_params=settings))

    def features(self, texts: list[bytes]) -> np.ndarray:
        rows = np.empty((len(texts), 4))
        for row, text in zip(rows, texts):
            good, bad = (sum(len(c.compress(piece)) for piece in _pieces(text)) for c in self.compressors)
            per_byte = max(1, len(text))
            row[:] = 1, (bad - good) / max(good, bad), min(MOST_PER_BYTE, good / per_byte), min(MOST_PER_BYTE, bad / per_byte)
        return rows


def _curve(rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows, -30, 30)))


def _fit_curve(rows: np.ndarray, good: np.ndarray, penalty: float = 1e-5, steps: int = 100) -> np.ndarray:
    """Logistic regression by Newton steps, slightly penalised so that separable rows have an answer too."""
    weights = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = _curve(rows @ weights)
        slope = rows.T @ (p - good) / len(rows) + penalty * weights
        bend = rows.T @ (rows * (p * (1 - p))[:, None]) / len(rows) + penalty * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit_sample(texts: list[bytes], good: list[bool]) -> QualityModel:
    """Fit on a sample in its order: the first half of each class gives the dictionaries, the rest the curve.

    Lines that both classes have say nothing about quality and are left out of the dictionaries.
    """
    share = (sum(good) + 1) / (len(good) + 2)
    by_class = [[t for t, g in zip(texts, good) if g == want] for want in (True, False)]
    if min(map(len, by_class)) < 2:
        return QualityModel(b"", b"", None, share)
    halves = [own[: len(own) // 2] for own in by_class]
    common = set.intersection(*({line for text in half for line in text.split(b"\n")} for half in halves))
    cleaned = [[b"\n".join(x for x in text.split(b"\n") if x not in common) for text in half] for half in halves]
    dictionaries = [_dictionary(own) for own in cleaned]
    rest = [own[len(own) // 2 :] for own in by_class]
    rows = _Sizes(*dictionaries).features(rest[0] + rest[1])
    truth = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    return QualityModel(*dictionaries, _fit_curve(rows, truth), share)


def held_out(doc_id: str) -> Column:
    """Rows that never serve the fit: those with crc32 of the id's text, mod 4, equal to 2. A null id has no label."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS
) -> QualityModel:
    """Fit on labelled rows that are not held out. Ids with contradicting labels are not used; a null text is empty.

    Of several texts with one id the smallest is taken, whatever the order of rows.
    """
    marked = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .where(~held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("id", "label", F.xxhash64("id", F.lit("sample")).alias("at"))
    )
    chosen = None
    for value in (0, 1):
        # Thinned out by hash first, so that few rows are ordered however many are labelled.
        own = hashed_sample(marked.where(F.col("label") == value), 2 * per_class, "id")
        own = own.orderBy("at", "id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    sample = (
        docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        .where(F.octet_length("body") <= SAMPLE_BYTES)
        .join(F.broadcast(chosen), "id")  # 2 * per_class rows of three numbers
        # Of several texts with one id the first in code-point order.
        .groupBy("at", "id", "label")
        .agg(F.min("body").alias("body"))
        .collect()  # at most 2 * per_class * sample_bytes bytes
    )
    sample.sort(key=lambda row: (row["at"], row["id"], row["body"]))
    return fit_sample([row["body"].encode() for row in sample], [row["label"] == 1 for row in sample])


def quality_score(model: QualityModel, text: str = "text") -> Column:
    """The score of every whole text, 0 to 1; a null text scores as an empty one."""
    good, bad, weights, share = model.good, model.bad, model.weights, model.share

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = _Sizes(good, bad) if weights is not None else None
        for texts in batches:
            out = np.full(len(texts), share)
            if sizes:
                at = 0
                for _, own in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", TOGETHER):
                    out[at : at + len(own)] = _curve(sizes.features(own) @ weights)
                    at += len(own)
            yield pa.array(out)

    return score(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `held_out`, `score` and `predicted` (1 from the threshold on).

    With fewer than two labelled rows in a class there is nothing to compare, and every score is the
    smoothed share of good rows. Empty texts get a score as any other; columns besides the two read are ignored.
    """
    model = fit_quality(docs, labels, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), quality_score(model, text).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be good, with all their columns."""
    return docs.where(quality_score(fit_quality(docs, labels, doc_id, text), text) >= threshold)
