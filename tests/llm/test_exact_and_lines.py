import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairwright.llm.exact import directory, exact_dedup
from pairwright.llm.lines import line_dedup, spread_lines


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_copies_are_found_by_their_normalised_bytes(docs, corpus):
    groups = defaultdict(list)
    for doc, text, _ in corpus:
        groups[norm(text)].append(doc)
    want = {}
    for text, members in groups.items():
        for doc in members:
            digest = hashlib.sha256(text.encode()).hexdigest()
            want[doc] = (min(members), len(members), doc == min(members), digest)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, bucket_slots=7).collect()}
    assert got == want


def test_directory_doubles_only_where_buckets_are_overfull(spark):
    slots = spark.range(4000).select(F.xxhash64("id").alias("key"))
    entries, last = directory(slots, bucket_slots=70, doublings=3)
    rows = entries.collect()
    assert len(rows) == 2**last
    held = defaultdict(int)
    for r in slots.select(F.shiftrightunsigned("key", 64 - last).alias("entry")).collect():
        held[r.entry] += 1
    by_bucket = defaultdict(int)
    for r in rows:
        assert r.bucket == r.entry >> (last - r.depth) << (last - r.depth)
        by_bucket[r.bucket, r.depth] += held[r.entry]
    assert len({r.depth for r in rows}) > 1
    for (_, depth), n in by_bucket.items():
        assert n <= 70 or depth == last


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    """Keys that share their first 24 bits, far more than a first depth parts."""
    slots = spark.range(1000).select((F.shiftleft(F.lit(0x123456).cast("long"), 40) + F.col("id") * (1 << 29)).alias("key"))
    entries, last = directory(slots, bucket_slots=10, doublings=3)
    held = defaultdict(int)
    buckets = {r.entry: r.bucket for r in entries.collect()}
    for r in slots.select(F.shiftrightunsigned("key", 64 - last).alias("entry")).collect():
        held[buckets[r.entry]] += 1
    assert last > 24 and sum(held.values()) == 1000 and max(held.values()) <= 10


def test_copies_are_found_where_the_directory_deals_them(spark, docs, monkeypatch):
    """The owners of the buckets find the copies: without directory entries there are none."""
    from pairwright.llm import exact

    assert exact_dedup(docs, bucket_slots=7).where("group_size > 1").count() > 0
    build = exact.build_index

    def astray(slots, bucket_slots):
        index, entries, last = build(slots, bucket_slots)
        return index, entries.where("false"), last

    monkeypatch.setattr(exact, "build_index", astray)
    assert exact_dedup(docs, bucket_slots=7).where("group_size > 1").count() == 0


def test_a_text_on_a_third_of_all_rows(spark):
    frame = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("one  and\tthe same")).otherwise(F.col("id").cast("string")).alias("text")
    )
    got = exact_dedup(frame, bucket_slots=50)
    assert got.where("group_size = 2000 AND keep_id = 1").count() == 2000
    assert got.where("kept").count() == 4001


def test_exact_dedup_of_odd_rows(odd, nothing):
    rows = exact_dedup(odd).collect()
    assert len(rows) == 6
    same = [r for r in rows if r.group_size == 4]
    assert {r.keep_id for r in same} == {1} and [r.kept for r in same if r.doc_id != 1] == [False, False]
    assert [r.kept for r in rows if r.doc_id is None and r.group_size == 1] == [True]
    assert exact_dedup(nothing).collect() == []


def cleaned(corpus, min_sites):
    sites, first = defaultdict(set), {}
    for doc, text, site in corpus:
        for line in (text or "").split("\n"):
            line = line.strip(" \t\r")
            if line:
                if site is not None:
                    sites[line].add(site)
                first[line] = min(doc, first.get(line, doc))
    out = {}
    for doc, text, _ in corpus:
        if text is None:
            out[doc] = None
            continue
        keep = []
        for raw in text.split("\n"):
            line = raw.strip(" \t\r")
            if not line or len(sites[line]) < min_sites or first[line] == doc:
                keep.append(raw)
        out[doc] = "\n".join(keep)
    return out


@pytest.mark.parametrize("min_sites", [2, 5])
def test_spread_lines_stay_in_their_first_document(docs, corpus, min_sites):
    got = {r.doc_id: r.text for r in line_dedup(docs, min_sites=min_sites).collect()}
    want = cleaned(corpus, min_sites)
    assert got == want
    assert any(want[doc] != text for doc, text, _ in corpus)


def test_exact_counts_decide_near_the_threshold(docs):
    exact = {(r.line_a, r.line_b) for r in spread_lines(docs, min_sites=3, near=50.0).collect()}
    assert exact and exact == {(r.line_a, r.line_b) for r in spread_lines(docs, min_sites=3).collect()}


def test_line_dedup_of_odd_rows(odd, nothing):
    cut = line_dedup(odd, min_sites=1)
    assert cut.columns == [*odd.columns, "_n_lines", "__n_cut"]
    rows = cut.collect()
    assert {(r.doc, r.version, r._places, r._version) for r in rows} == {("doc", "version", "_places", "x")}
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == [
        (0, ""), (0, ""), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, ""), (2, "quite another text here"),
    ]
    assert line_dedup(nothing).collect() == []


@pytest.mark.parametrize("operator", [exact_dedup, line_dedup])
def test_no_python_on_the_way(docs, operator):
    plan = operator(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
