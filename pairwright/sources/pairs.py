"""Pair tables as CSV or Parquet.

At rest the turn lists are JSON text in both formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.turns import decode_turns, encode_turns
from pairwright.schemas import FOLD, PAIR_TEXT, ROW_KEY, TURN_COLUMNS

# RFC 4180 quoting: a quote inside a field is doubled.
_CSV = {"header": "true", "quote": '"', "escape": '"'}


def pair_columns(df: DataFrame) -> list[str]:
    """The pair columns in file order, then `row_id` and `fold` where they exist."""
    names = [field.name for field in PAIR_TEXT.fields]
    return names + [more.name for more in (ROW_KEY, FOLD) if more.name in df.columns]


def encode_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: encode_turns(F.col(c)) for c in TURN_COLUMNS}).select(
        *pair_columns(pairs)
    )


def decode_pairs(text: DataFrame) -> DataFrame:
    return text.withColumns({c: decode_turns(F.col(c)) for c in TURN_COLUMNS})


def write_pairs(pairs: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    """Write a pair table; Parquet is partitioned by `fold` where the column exists."""
    text = encode_pairs(pairs)
    if kind == "csv":
        # Empty texts and nulls must stay apart, so nulls get a mark of their own.
        text.write.mode(mode).options(**_CSV, nullValue="\\N", emptyValue='""').csv(path)
    elif kind == "parquet":
        if FOLD.name in text.columns:
            # Rebalancing splits a big fold over several files.
            folded = text.hint("rebalance", FOLD.name)
            folded.write.mode(mode).partitionBy(FOLD.name).parquet(path)
        else:
            text.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"kind is 'csv' or 'parquet', not {kind!r}")


def read_pairs(
    spark: SparkSession,
    path: str,
    kind: str,
    with_fold: bool = False,
    multi_line: bool = True,
    with_row_id: bool = False,
) -> DataFrame:
    """Read a pair table with its explicit schema.

    `multi_line` lets fields of foreign files hold line breaks, at the price of
    one task per file. JSON text never holds any, so files written by
    `write_pairs` can be read with it off, and are then split by blocks. A file
    whose header names other columns or another order ends the job, as does a
    row that does not fit.
    """
    more = [*([ROW_KEY] if with_row_id else []), *([FOLD] if with_fold else [])]
    schema = T.StructType([*PAIR_TEXT.fields, *more])
    if kind == "csv":
        options = {**_CSV, "nullValue": "\\N", "emptyValue": "", "multiLine": str(multi_line)}
        options |= {"enforceSchema": "false", "mode": "FAILFAST"}
        text = spark.read.schema(schema).options(**options).csv(path)
    elif kind == "parquet":
        text = spark.read.schema(schema).parquet(path)
    else:
        raise ValueError(f"kind is 'csv' or 'parquet', not {kind!r}")
    return decode_pairs(text)
