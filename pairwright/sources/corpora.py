"""Chat logs and chosen/rejected corpora, from local or shared copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.keys import with_row_key
from pairwright.schemas import CHAT_LOG, CORPUS

# The corpora the pseudo-label stage takes in, in file order.
CORPUS_NAMES = (
    "Capybara",
    "PKU-SafeRLHF-30K-standard",
    "Argilla-Math-DPO-standard",
    "CodeUltraFeedback-standard",
    "HelpSteer",
)


def _read(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    if kind == "json":
        # A line that is no such row ends the job.
        return reader.option("mode", "FAILFAST").json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"kind is 'json' or 'parquet', not {kind!r}")


def read_chat_log(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(row_id, model, conversation) rows; the key is made from their content."""
    return with_row_key(_read(spark, path, kind, CHAT_LOG))


def read_corpus(
    spark: SparkSession, path: str, name: str, kind: str = "parquet", keyed: bool = False
) -> DataFrame:
    """(row_id, chosen, rejected, corpus) rows.

    Public corpora bring no key, so one is made from the content; `keyed` files have their own.
    """
    rows = _read(spark, path, kind, CORPUS)
    if not keyed:
        rows = with_row_key(rows.drop("row_id"))
    return rows.withColumn("corpus", F.lit(name))


def write_corpus(corpus: DataFrame, path: str, kind: str = "parquet", keyed: bool = True) -> None:
    columns = [field.name for field in CORPUS.fields if keyed or field.name != "row_id"]
    corpus.select(*columns).write.format(kind).save(path)
