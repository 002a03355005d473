"""Row keys for files that bring none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.operators.filters import may_be_among
from pairwright.staging import stage

NESTED = (T.ArrayType, T.StructType, T.MapType)


def content_key(df: DataFrame) -> Column:
    """Digest of a row's content: its columns in their order, lists as JSON, each behind its length.

    The lengths keep columns apart, and a null, which has none, from an empty text.
    """
    parts = []
    for field in df.schema.fields:
        text = F.to_json(field.name) if isinstance(field.dataType, NESTED) else F.col(field.name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def with_row_key(df: DataFrame, name: str = "row_id") -> DataFrame:
    """`df` with a key per row, as its first column: the digest of its content and a number among equal rows.

    The key does not hang on file order or on the cluster. Digests are counted, and rows whose content is there
    once stay where they are. Equal rows are interchangeable, so those of a repeated content are counted, too, and
    dealt out again with their numbers: each task moves one of them. `df` is read three times.
    """
    # A row number in it that changes nothing: what hangs on one is worked out once, not for each use in a filter.
    never = F.when(F.monotonically_increasing_id() < 0, F.lit("-")).otherwise(F.lit(""))
    keyed = df.withColumn("_content", F.concat(content_key(df), never))
    repeated = stage(keyed.groupBy("_content").agg(F.count("*").alias("_n")).where("_n > 1").select("_content"), "repeated")
    several = may_be_among(repeated, "_content")
    single = keyed.where(~several).withColumn("_copy", F.lit(1).cast("long"))
    # Grouped by their own columns, so no row is sorted; what the filter let through by mistake has one copy.
    counted = keyed.where(several).groupBy("_content", *df.columns).agg(F.count("*").alias("_n"))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
    return single.unionByName(copies).select(F.concat_ws("-", "_content", "_copy").alias(name), *df.columns)
