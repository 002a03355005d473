"""Line de-duplication by the number of distinct sites a line is found on.

Every line's hash gets a HyperLogLog sketch of the sites it occurs on, merged by aggregation. Where the
estimate lies so near to the threshold that the sketch could be wrong, exact distinct counts decide.
Lines that reach the threshold are boilerplate; they stay in the first document that holds them and go
from all others, so that a document with copies on many sites is not lost with its copies.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import fresh, whole
from pairwright.staging import stage

MIN_SITES = 6
#: log2 of the sketch's registers: a standard error of 1.04 / sqrt(4096), below 2 %.
SKETCH_BITS = 12
#: Estimates within this share of the threshold are counted exactly: six standard errors.
NEAR = 0.1


def _lines(text: str) -> Column:
    """The lines of a text, trimmed of blanks, tabs and returns."""
    return F.transform(F.split(whole(text), "\n", -1), lambda line: F.btrim(line, F.lit(" \t\r")))


def spread_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
    near: float = NEAR,
) -> DataFrame:
    """Lines found on `min_sites` distinct sites or more: `line_a`, `line_b` and `first`, the smallest doc_id with it.

    Empty lines are never among them; a null site counts as none.
    """
    seen = (
        docs.select(F.col(doc_id).alias("doc"), F.col(site).cast("string").alias("site"), F.explode(_lines(text)).alias("line"))
        .where("line <> ''")
        .select("doc", "site", *line_key("line"))
    )
    sketched = seen.groupBy("line_a", "line_b").agg(
        F.count("site").alias("seen"),
        F.min("doc").alias("first"),
        F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"),
    )
    # A line on n sites was seen n times at least.
    judged = stage(
        sketched.where(F.col("seen") >= min_sites)
        .select("line_a", "line_b", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - near) - 1),
        "line-sites",
    )
    unsure = (F.col("sites") <= min_sites * (1 + near) + 1)
    counted = (
        seen.where("site IS NOT NULL")
        .join(judged.where(unsure).select("line_a", "line_b"), ["line_a", "line_b"], "left_semi")
        .groupBy("line_a", "line_b", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line_a", "line_b")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line_a", "line_b")
    )
    confirmed = judged.where(unsure).join(counted, ["line_a", "line_b"], "left_semi")
    return judged.where(~unsure).unionByName(confirmed).select("line_a", "line_b", "first")


def line_key(line: str) -> tuple[Column, Column]:
    """128 bits of a line, in two columns."""
    return F.xxhash64(line).alias("line_a"), F.xxhash64(line, F.lit("second")).alias("line_b")


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES, near: float = NEAR
) -> DataFrame:
    """`docs` with boilerplate lines gone from `text`, and the counts `_n_lines` and `_n_cut` as last columns.

    Lines end at line feeds; they are compared without outer blanks, tabs and returns, and lines without
    anything else stay, as does a line in all its places in the document with the smallest id (null: the
    largest) that holds it. A null text stays null, an empty one empty. Rows that repeat a doc_id are each
    cleaned by their own text. Columns of `docs` keep their names, order and types, whatever else they hold.
    """
    spread = stage(spread_lines(docs, doc_id, site, text, min_sites, near), "spread-lines")
    doc, version, own_version, places, n_lines, n_cut = fresh(docs, "doc", "version", "_version", "_places", "_n_lines", "_n_cut")
    cut = (
        docs.select(F.col(doc_id).alias(doc), F.xxhash64(text).alias(version), F.posexplode(_lines(text)).alias("place", "line"))
        .where("line <> ''")
        .select(doc, version, "place", *line_key("line"))
        .join(spread, ["line_a", "line_b"])
        .where(~F.col(doc).eqNullSafe(F.col("first")))
        .groupBy(doc, version)
        .agg(F.collect_set("place").alias(places))
    )
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda line, place: ~F.array_contains(F.col(places), place))
    joined = docs.withColumn(own_version, F.xxhash64(text)).join(
        cut, F.col(doc_id).eqNullSafe(F.col(doc)) & (F.col(own_version) == F.col(version)), "left"
    )
    changed = F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    # A document whose every line goes is left empty.
    return joined.select(
        *[changed.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).alias(n_lines),
        F.coalesce(F.size(places), F.lit(0)).alias(n_cut),
    )
