"""Near-duplicates by an inverted join on MinHash coordinates.

Documents with equal shingle sets are one class. Every class is posted under its (coordinate, value) pairs.
Two sets as alike as asked agree in at least `MATCHES` of `COORDINATES` values, but for one chance in a
million; so of each class's values, in order of how many classes have them, the `MATCHES - 1` most common
ones may be skipped: pairs still meet in what is left (prefix filter). Values that no other class has meet
nobody, and a class with fewer than `MATCHES` others' values is out.

1. In lists of up to `SHORT_LIST` classes all meet, in longer ones all meet the class with the smallest
   document. Collisions are counted per pair, the skipped values are looked up, and pairs with `MATCHES`
   agreements are confirmed on full sets. Their links contract families of any size without naming all
   their pairs.
2. Classes of long lists that still hold several components are joined exactly: on the rarest shingles of
   their sets, with the size and position bounds that such an overlap must satisfy. Confirmed pairs are
   links, too.

So every pair that shares a list is either confirmed or refuted, or its classes are linked already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.components import components
from pairwright.llm.shingles import set_keys, shingle_sets, signatures
from pairwright.llm.tables import fresh, text_slices
from pairwright.staging import stage

#: Coordinates, and how many must agree: P(Binomial(48, 0.8) < 24) is 8e-7.
COORDINATES, MATCHES = 48, 24
#: Lists up to this length are joined pair by pair, longer ones through their first class and their sets.
SHORT_LIST = 16
#: Similarity in hundredths.
ALIKE = 80
#: Bits of the filter that keeps texts without a candidate class out of the second reading: 1 MB at any size.
FILTER_BITS = 1 << 23
_PIECE = 1 << 15


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """`doc_id`, `digest` (of the text), `n` (shingles), `class` (64-bit key of the set; null without shingles) and `signature` of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            shingles, sizes = shingle_sets(texts, words)
            own = sizes > 0
            keys = pa.array(set_keys(shingles, sizes)[0], mask=~own)
            flat = signatures(shingles, sizes[own], COORDINATES).view(np.int32).ravel()
            offsets = np.zeros(len(sizes) + 1, np.int32)
            offsets[1:] = np.cumsum(own) * COORDINATES
            signed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            digests = pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), digests, pa.array(sizes), keys, signed], names=["doc_id", "digest", "n", "class", "signature"]
            )

    return docs.mapInArrow(sign, "doc_id long, digest binary, n long, class long, signature array<int>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """`class` and `shingles` (distinct, as longs) of each row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text"):
            shingles, sizes = shingle_sets(texts, words)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(shingles, sizes)[0]), lists], names=["class", "shingles"])

    return docs.mapInArrow(gather, "class long, shingles array<long>")


def _bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(0))), F.lit(FILTER_BITS))


def _maybe(ids: DataFrame) -> Column:
    """Whether a doc_id may be among `ids`: a bit per hash, so never a wrong no. The driver sees 1 MB at most."""
    bit = _bit("doc_id")
    rows = (
        ids.select(F.floor(bit / _PIECE).cast("long").alias("piece"), (bit % _PIECE).alias("at"))
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
        .collect()
    )
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        held[row["piece"] * (_PIECE // 8) : (row["piece"] + 1) * (_PIECE // 8)] = np.frombuffer(row["bits"], np.uint8)

    @F.arrow_udf("boolean")
    def among(bits: pa.Array) -> pa.Array:
        at = bits.to_numpy(zero_copy_only=False)
        return pa.array((held[at >> 3] >> (at & 7) & 1).astype(bool))

    return among(bit)


def _prefix(classes: DataFrame) -> DataFrame:
    """Postings (`class`, `least`, `n`, `code`) of the values that are not skipped; a code is a coordinate and its value."""
    code = F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("class", F.posexplode("signature").alias("coordinate", "value")).select("class", code.alias("code"))
    held = posted.groupBy("code").agg(F.count("*").alias("held")).where("held > 1")
    ordered = (
        posted.join(held.hint("merge"), "code")
        .groupBy("class")
        .agg(F.sort_array(F.collect_list(F.struct("held", "code"))).alias("values"))
        .where(F.size("values") >= MATCHES)
        .select("class", F.explode(F.slice("values", F.lit(1), F.size("values") - (MATCHES - 1))).alias("p"))
    )
    return ordered.select("class", "p.code").join(classes.select("class", "least", "n").hint("merge"), "class")


def _sizes_fit(alike: int) -> Column:
    return F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * alike


def _confirmed(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """The pairs (`class`, `other`) whose full sets are as alike as asked, as links (u, v)."""
    other = sets.select(F.col("class").alias("other"), F.col("shingles").alias("other_shingles"))
    common = F.size(F.array_intersect("shingles", "other_shingles"))
    return (
        pairs.select("class", "other")
        .join(sets.hint("merge"), "class")
        .join(other.hint("merge"), "other")
        .where(common * (100 + alike) >= (F.size("shingles") + F.size("other_shingles")) * alike)
        .select(F.col("class").alias("u"), F.col("other").alias("v"))
    )


def _met_pairs(prefix: DataFrame, lists: DataFrame, classes: DataFrame, alike: int) -> DataFrame:
    """Pairs (`class`, `other`) that meet in a list and agree in enough values of their whole signatures."""
    short, long = lists.where(F.col("held") <= SHORT_LIST), lists.where(F.col("held") > SHORT_LIST)
    # Both sides of a short list are one row per list, which holds a bounded number of classes.
    grouped = prefix.join(short.select("code"), "code", "left_semi").groupBy("code").agg(F.collect_list(F.struct("class", "n")).alias("met"))
    one = grouped.select("code", "met", F.explode("met").alias("one"))
    beside = one.select("one", F.explode("met").alias("two")).where("one.class < two.class").select(
        F.col("one.class").alias("class"), F.col("one.n").alias("n"), F.col("two.class").alias("other"), F.col("two.n").alias("other_n")
    )
    starred = prefix.join(long, "code").select(
        "class", "n", F.col("first.class").alias("other"), F.col("first.n").alias("other_n")
    )
    pairs = (
        beside.unionByName(starred.where(F.col("class") != F.col("other")))
        .where(_sizes_fit(alike))
        .select(F.least("class", "other").alias("class"), F.greatest("class", "other").alias("other"))
        .groupBy("class", "other")
        .agg(F.count("*").alias("collisions"))
    )
    signed = classes.select("class", "signature")
    agreed = F.size(F.filter(F.zip_with("signature", "other_signature", lambda a, b: a == b), lambda same: same))
    return (
        pairs.join(signed.hint("merge"), "class")
        .join(signed.select(F.col("class").alias("other"), F.col("signature").alias("other_signature")).hint("merge"), "other")
        .where(agreed >= MATCHES)
        .select("class", "other")
    )


def _rest_pairs(crowded: DataFrame, sets: DataFrame, roots: DataFrame, alike: int) -> DataFrame:
    """Pairs of classes that share a long list (`class`, `code`) but no component yet and whose sets may be alike.

    Shingles are ordered by how many of these classes have them. Alike sets share one of their first
    n - ceil(alike * n) + 1, and at the first shared one both have enough left for the overlap.
    """
    rooted = crowded.join(roots.hint("merge"), crowded["class"] == roots["node"], "left").select(
        "class", "code", F.coalesce("root", "class").alias("root")
    )
    mixed = rooted.groupBy("code").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    left = stage(rooted.join(mixed.select("code"), "code", "left_semi").select("class", "root").distinct(), "unsettled")
    own = left.join(sets.hint("merge"), "class").select("class", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = own.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    first = F.col("n") - F.ceil(F.col("n") * alike / 100) + 1
    alone = F.col("n") - F.size("shared")  # shingles of this class alone come first in its order
    ranked = (
        own.join(held.hint("merge"), "shingle")
        .groupBy("class", "root", "n")
        .agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
        .where(first > alone)
        .select("class", "root", "n", alone.alias("alone"), F.slice("shared", F.lit(1), (first - alone).cast("int")).alias("shared"))
        .select("class", "root", "n", "alone", F.posexplode("shared").alias("at", "s"))
        .select("class", "root", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), F.col("s.shingle").alias("shingle"))
    )
    postings = stage(ranked, "rare-shingles")
    lists = postings.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("shingle")
    mixed_postings = postings.join(lists, "shingle", "left_semi")
    a, b = mixed_postings.alias("a"), mixed_postings.alias("b")
    asked = (F.col("a.n") + F.col("b.n")) * alike
    fits = (
        (F.col("a.class") < F.col("b.class"))
        & (F.col("a.root") != F.col("b.root"))
        & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * alike)
        & (F.least("a.rest", "b.rest") * (100 + alike) >= asked)
    )
    return (
        a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & fits)
        .select(F.col("a.class").alias("class"), F.col("b.class").alias("other"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, alike: int = ALIKE) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_shingles`, `component_id` and `kept`.

    Words are runs of other than ASCII white space, A-Z in lower case. Documents are linked if their sets of
    distinct shingles of `words` words have a Jaccard similarity of `alike` hundredths or more; the
    component is named by its smallest doc_id, and that document is kept. A text with fewer words is one
    shingle; null, empty and blank texts have none, are linked with nothing and kept. Rows that repeat a
    doc_id are judged by their own texts. A null doc_id never names a component that has another.
    Sets count as equal if their 64-bit keys are; full sets are compared by 64-bit shingles.
    """
    signed, owners = _judged(docs, doc_id, text, words, alike)
    return signed.select("doc_id", F.col("n").alias("n_shingles"), "class").join(owners.hint("merge"), "class", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _judged(docs: DataFrame, doc_id: str, text: str, words: int, alike: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and of each class its `component` (the smallest doc_id) and `root` (of a component; null alone)."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stage(_signed(read, words), "signatures")
    classes = stage(
        signed.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )
    prefix = stage(_prefix(classes), "prefix")
    lists = stage(
        prefix.groupBy("code")
        .agg(F.min(F.struct("least", "class", "n")).alias("first"), F.count("*").alias("held"))
        .where("held > 1"),
        "lists",
    )
    pairs = stage(_met_pairs(prefix, lists, classes, alike), "met-pairs")
    crowded = stage(
        prefix.join(lists.where(F.col("held") > SHORT_LIST).select("code"), "code", "left_semi").select("class", "code"), "long-lists"
    )
    asked = pairs.select("class").union(pairs.select("other")).union(crowded.select("class")).distinct()
    wanted = stage(asked.join(classes.select("class", F.col("least").alias("doc_id")).hint("merge"), "class"), "wanted")
    candidates = _sets(read.where(_maybe(wanted)), words).join(wanted.select("class").hint("merge"), "class", "left_semi")
    sets = stage(candidates.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")
    links = stage(_confirmed(pairs, sets, alike), "links")
    rest = stage(_confirmed(_rest_pairs(crowded, sets, components(links), alike), sets, alike), "rest-links")
    roots = components(links.unionByName(rest))
    named = roots.join(classes.select(F.col("class").alias("node"), "least").hint("merge"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    found = named.join(least, "root").select(F.col("node").alias("class"), "root", "component")
    owners = classes.select("class", "least").join(found.hint("merge"), "class", "left").select(
        "class", "root", F.coalesce("component", "least").alias("component")
    )
    return signed, owners


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, alike: int = ALIKE) -> DataFrame:
    """One row of each group that `near_duplicates` links, and all rows without shingles, with all their columns.

    Rows are told apart by doc_id and text, so a doc_id that repeats goes with those of its texts only that are
    near copies. A group keeps the row with its smallest doc_id (null last), of several texts of that the one
    with the smallest SHA-256, of rows alike in both any one.
    """
    signed, owners = _judged(docs, doc_id, text, words, alike)
    rows = signed.where("class IS NOT NULL").select("doc_id", "digest", "class")
    # Written, so that a large group's rows can be dealt to several tasks in both joins.
    roots = stage(owners.select("class", "root"), "roots")
    grouped = rows.join(roots.hint("merge"), "class").select(
        F.coalesce("root", "class").alias("group"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("row")
    )
    counted = stage(grouped.groupBy("group", "row").agg(F.count("*").alias("times")), "group-rows")
    first = stage(counted.groupBy("group").agg(F.min("row").alias("first")), "group-firsts")
    marked = counted.join(first.hint("merge"), "group")
    name, body, given, seen = fresh(docs, "_gone", "_body", "_given", "_seen")
    row = [F.col("row.doc_id").alias(name), F.col("row.digest").alias(body)]
    gone = marked.where(F.col("row") != F.col("first")).select(*row)
    twice = stage(marked.where((F.col("row") == F.col("first")) & (F.col("times") > 1)).select(*row), "repeated-rows")
    keyed = docs.withColumns(
        {given: F.col(doc_id).cast("long"), seen: F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))}
    )
    same = F.col(given).eqNullSafe(F.col(name)) & (F.col(seen) == F.col(body))
    kept = keyed.join(gone.unionByName(twice).hint("merge"), same, "left_anti")
    if not twice.isEmpty():
        kept = kept.unionByName(keyed.join(twice.hint("merge"), same, "left_semi").dropDuplicates([given, seen]))
    return kept.drop(given, seen)
