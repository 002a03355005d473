"""What the operators share: reading a table, null-safe columns, names that cannot clash."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def task_count(df: DataFrame, least: int = 1) -> int:
    """Tasks to deal rows to by an explicit key; AQE cannot split those, so it follows the session."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hashed_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About `rows` rows of `df`, chosen by the hash of `by`: the same ones on every run, however many there are."""
    share = min(1.0, rows / max(1, df.count()))
    place = F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(1 << 40))
    return df.where(place < int(share * (1 << 40)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` has, in whatever case: the ones given, behind as many underscores as it takes."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, rows: int = 256, size: int = 1 << 19
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts as bytes (null as empty), a bounded number and size at a time, one row at least."""
    for batch in batches:
        begin = held = 0
        texts: list[bytes] = []
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            for text in part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist():
                text = text or b""
                if texts and (len(texts) >= rows or held + len(text) > size):
                    yield batch.slice(begin, len(texts)), texts
                    begin, held, texts = begin + len(texts), 0, []
                texts.append(text)
                held += len(text)
        if texts:
            yield batch.slice(begin, len(texts)), texts


def give_back() -> None:
    """Return memory that this worker has freed: it lives on beside the tasks of other queries."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # the C library of most Linux systems has it
        trim(0)
