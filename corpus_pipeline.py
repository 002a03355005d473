"""Documents to training sequences: good ones, without boilerplate, near copies and repeated passages, packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes to the shared folder and
reads again for the next stage. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.lines import line_dedup
from pairwright.llm.minhash import keep_one
from pairwright.llm.packing_fit import pack_texts
from pairwright.llm.quality import keep_good
from pairwright.llm.queries import tokenizer_file
from pairwright.llm.suffix import without_repeats
from pairwright.llm.tables import read_table
from pairwright.staging import stage


def _measured(docs: DataFrame) -> DataFrame:
    """`n_chars` of the text as it is now; as it was where there is no text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are spread over many sources stay in the first document with them only."""
    return _measured(line_dedup(docs).select(*docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8."""
    return keep_one(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more that an earlier document has are cut out."""
    return _measured(without_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack_texts(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("minhash near-dedup", one_of_each),
    ("suffix-array dedup", without_passages),
    ("best-fit packing", packed),
]

#: SQL has no compressor with dictionaries; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
