"""Scorers and tokenizers brought by the user, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.text import Tokens
from pairwright.operators.ensemble import LOGIT_COLUMNS, softmax_probs
from pairwright.schemas import PROBABILITY_COLUMNS

# Frame of input columns -> one row of three logits per frame row.
Scorer = Callable[[pd.DataFrame], np.ndarray]
# Texts -> (texts cut to the limit, token counts).
Tokenizer = Callable[[pd.Series], tuple[pd.Series, pd.Series]]
# Texts and a limit, or none -> (texts cut to the limit, token counts of the whole texts).
LimitedTokenizer = Callable[[pd.Series, int | None], tuple[pd.Series, pd.Series]]


_made: dict[str, Scorer] = {}


@dataclass(frozen=True)
class MadeOnce:
    """A scorer that each Python worker makes once, by `factory`, and keeps under `name`.

    Tasks carry the factory instead of the weights it loads.
    """

    name: str
    factory: Callable[[], Scorer]

    def __call__(self, frame: pd.DataFrame) -> np.ndarray:
        if self.name not in _made:
            _made[self.name] = self.factory()
        return _made[self.name](frame)


def _logits(scorer: Scorer, frame: pd.DataFrame) -> np.ndarray:
    return np.asarray(scorer(frame), dtype="float64").reshape(len(frame), 3)


def score_logits(
    df: DataFrame, scorers: Mapping[str, Scorer], inputs: Sequence[str], row_id: str = "row_id"
) -> DataFrame:
    """(row_id, scorer, three logits), a row per scorer, in one pass over `df`.

    Results carry their key, so order does not matter. Only `inputs` travel to
    Python. What a scorer holds is pickled with it once per task; see `MadeOnce`.
    """
    id_type = df.schema[row_id].dataType
    schema = T.StructType(
        [T.StructField("row_id", id_type), T.StructField("scorer", T.StringType())]
        + [T.StructField(column, T.DoubleType()) for column in LOGIT_COLUMNS]
    )
    columns = list(inputs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, scorer in scorers.items():
                logits = _logits(scorer, frame[columns])
                out = {"row_id": frame["_id"], "scorer": name}
                out.update({column: logits[:, i] for i, column in enumerate(LOGIT_COLUMNS)})
                yield pd.DataFrame(out)

    return df.select(F.col(row_id).alias("_id"), *columns).mapInPandas(run, schema)


def score(
    df: DataFrame, scorers: Mapping[str, Scorer], inputs: Sequence[str], row_id: str = "row_id"
) -> DataFrame:
    """(row_id, scorer, three probabilities)."""
    logits = score_logits(df, scorers, inputs, row_id)
    return softmax_probs(logits).select("row_id", "scorer", *PROBABILITY_COLUMNS)


def mean_probabilities(scorers: Mapping[str, Scorer], inputs: Sequence[str]) -> Column:
    """The scorers' mean probabilities of a row, as a struct: narrow, so no row is moved for it."""
    columns = list(inputs)

    def run(*values: pd.Series) -> pd.DataFrame:
        frame = pd.DataFrame(dict(zip(columns, values)))
        total = np.zeros((len(frame), 3))
        for scorer in scorers.values():
            logits = _logits(scorer, frame)
            powers = np.exp(logits - logits.max(axis=1, keepdims=True))
            total += powers / powers.sum(axis=1, keepdims=True)
        return pd.DataFrame(total / len(scorers), columns=list(PROBABILITY_COLUMNS))

    # Types are given here: postponed annotations of a nested function cannot be read.
    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{name} double" for name in PROBABILITY_COLUMNS))(*columns)


def tokenize_with(tokenizer: Tokenizer) -> Callable[[Column], Column]:
    """A column function text -> struct(text, n_tokens) around a tokenizer of the user's."""

    def run(texts: pd.Series) -> pd.DataFrame:
        kept, counts = tokenizer(texts)
        return pd.DataFrame({"text": kept, "n_tokens": counts})

    # Types are given here: postponed annotations of a nested function cannot be read.
    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "text string, n_tokens int")


def tokens_of(tokenizer: LimitedTokenizer) -> Tokens:
    """A tokenizer of the user's for rendering, measuring and batch plans."""

    def limited(limit: int | None) -> Callable[[Column], Column]:
        return tokenize_with(lambda texts: tokenizer(texts, limit))

    return Tokens(
        cut=lambda text, limit: limited(limit)(text)["text"],
        count=lambda text: limited(None)(text)["n_tokens"],
        batch=tokenizer,
    )


# Logits of a micro batch: (batch_id, shard, micro_batch, row, row_id, variant_no, is_pad, three logits).
_PLACE = ("batch_id", "shard", "micro_batch")
_SAMPLE = ("row", "row_id", "variant_no", "is_pad")


def score_micro_batches(batches: DataFrame, scorer: Scorer, inputs: Sequence[str] = ("input_text", "seq_len")) -> DataFrame:
    """Logits of planned micro batches, a row per sample with its place; `restore_order` brings them back in order.

    `batches` are those of `micro_batch_texts`. The scorer gets the samples of one micro batch at a time, in row
    order, as a frame of `inputs`, so what it holds at once is what the token budget of the plan allows. Padding is
    scored as well, as the shards of a batch work in step.
    """
    sample = batches.schema["samples"].dataType.elementType
    schema = T.StructType(
        [T.StructField(name, batches.schema[name].dataType) for name in _PLACE]
        + [T.StructField(name, sample[name].dataType) for name in _SAMPLE]
        + [T.StructField(column, T.DoubleType()) for column in LOGIT_COLUMNS]
    )
    columns = list(inputs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                one = part.slice(at, 1)
                samples = pa.Table.from_struct_array(one.column("samples").flatten())
                logits = _logits(scorer, samples.select(columns).to_pandas())
                arrays = [pa.repeat(one.column(name)[0], samples.num_rows) for name in _PLACE]
                arrays += [samples.column(name).combine_chunks() for name in _SAMPLE]
                arrays += [pa.array(logits[:, i]) for i in range(len(LOGIT_COLUMNS))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return batches.select(*_PLACE, "samples").mapInArrow(run, schema)
