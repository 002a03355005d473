import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairwright.llm import fingerprints as fp
from pairwright.llm.fingerprints import CELLS, Sketches, compare_with_next, digests, likeness, peel, recovered
from pairwright.llm.url_rules import judge_urls, rule_table


def alike(a, b):
    def cut(text):
        return Counter(fp.paragraphs(text))

    first, second = cut(a), cut(b)
    together = sum((first | second).values())
    return sum((first & second).values()) / together if together else 1.0


def test_fingerprints_against_paragraph_counts(docs, corpus):
    rows = sorted(((d, t or "") for d, t, _ in corpus), reverse=True)
    want = {}
    for (doc, text), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        want[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(text, edited), alike(text, follower))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in compare_with_next(docs).collect()}
    assert got == want
    prints = {}
    texts = {d: t or "" for d, t, _ in corpus}
    for r in compare_with_next(docs).collect():
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_borders_do_not_matter(docs, monkeypatch):
    want = sorted(map(tuple, compare_with_next(docs).collect()))
    monkeypatch.setattr(fp, "RANGES", 40)
    assert sorted(map(tuple, compare_with_next(docs).collect())) == want


def test_peeling_recovers_differences_and_retries_larger():
    rng = np.random.default_rng(0)
    sizes = [(0, 0, 0), (5, 0, 0), (0, 3, 0), (10, 4, 4), (100, 300, 2), (1500, 900, 700)]
    first, second, want = [], [], []
    for common, a, b in sizes:
        keys = rng.integers(1, 1 << 62, common + a + b).astype(np.uint64)
        first.append(rng.permutation(keys[: common + a]))
        second.append(rng.permutation(np.concatenate([keys[:common], keys[common + a :]])))
        want.append((set(keys[common : common + a].tolist()), set(keys[common + a :].tolist())))
    small = Sketches.of(first, CELLS) - Sketches.of(second, CELLS)
    empty = peel(small)[3]
    assert empty[:3].all() and not empty[4:].any()
    got = [(set(x.tolist()), set(y.tolist())) for x, y in recovered(first, second)]
    assert got == want
    near = likeness(first, second, (Sketches.of(first), Sketches.of(second)))
    assert near[0] == 1.0 and near[1] == 1.0 and near[3] == 10 / 18


def test_copies_of_a_paragraph_count():
    own = digests("a.\na.\nb.")
    assert len(set(own.tolist())) == 3 and set(digests("a.\nb.").tolist()) < set(own.tolist())


def test_equal_digests_in_one_text_end_the_retries():
    twice = np.array([7, 7], np.uint64)
    (only_a, only_b), = recovered([twice], [np.zeros(0, np.uint64)])
    assert only_a.tolist() == [7] and not len(only_b)


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    rows = compare_with_next(odd).collect()
    assert len(rows) == 6 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert compare_with_next(nothing).collect() == []
    single = compare_with_next(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("b.example.org", "/e", "allow"), ("a.b.example.org", "", "block"), ("Net", "/x", "block"), ("net", "/x", "allow"),
    ("", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("c.net", "/xy", "allow"), ("d.c.net", "/x", "allow"),
]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for h, p, verdict in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), verdict, h + p))
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_against_every_rule(spark):
    rng = random.Random(4)
    hosts = ["org", "example.org", "b.example.org", "a.b.example.org", "z.a.b.example.org", "x.com", "COM", "net", "c.net", "d.c.net", "e.d.c.net", "notexample.org", "", ".org", "a..org", "ü.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/en/2#a", "/fr/x", "/e", "/x", "/xy", "/xyz", "?/x", "#/x", "/\n", "/é"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "//", "a://b://") for h in hosts for p in paths]
    rows = [(i, rng.choice(urls)) for i in range(1500)] + [(None, None), (3, ""), (3, ""), (4, "://"), (5, "x"), (6, "http://www.example.org/" + "p" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).repartition(3)
    got = sorted(((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in judge_urls(pages, rule_table(spark, RULES)).collect()))
    want = []
    for page, url in rows:
        host, path, rule, verdict = judged(url)
        want.append((page is None, page or 0, host, path, rule or "", verdict))
    assert got == sorted(want)
    assert sum(bool(row[4]) for row in want) > 300


def test_no_rules_or_no_urls(spark):
    none = rule_table(spark, [])
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, none, default="block").collect()] == [(1, "a.org", "/", None, "block")]
    assert judge_urls(pages.limit(0), rule_table(spark, RULES)).collect() == []
