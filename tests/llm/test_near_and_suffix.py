import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pairwright.llm import induced, minhash
from pairwright.llm.components import components
from pairwright.llm.minhash import keep_one, near_duplicates
from pairwright.llm.shingles import shingle_sets
from pairwright.llm.suffix import Contexts, cut_repeats, without_repeats

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, words):
    run = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(run) >= words:
        return {tuple(run[i : i + words]) for i in range(len(run) - words + 1)}
    return {tuple(run)} if run else set()


def near_by_pairs(corpus, words):
    sets = {doc: shingles(text, words) for doc, text, *_ in corpus}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), find(doc), find(doc) == doc) for doc in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(docs, corpus, words):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=words).collect()}
    want = near_by_pairs(corpus, words)
    assert got == want
    assert sum(not kept for _, _, kept in want.values()) > 10


def family(size, seed=3):
    """Copies of one text, each with so many changes that some are alike, some only over others, some not at all."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    center = rng.choices(words, k=120)
    rows = []
    for doc in range(size):
        own = list(center)
        for _ in range(rng.randint(0, 22)):
            own[rng.randint(0, 119)] = rng.choice(words)
        rows.append((doc, " ".join(own)))
    return rows


@pytest.mark.parametrize("short", [0, 3, 16])
def test_long_lists_lose_no_link(spark, monkeypatch, short):
    monkeypatch.setattr(minhash, "SHORT_LIST", short)
    rows = family(90)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, words=2).collect()}
    want = {doc: root for doc, (_, root, _) in near_by_pairs(rows, 2).items()}
    assert got == want
    assert 2 < len(set(want.values())) < 90


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = near_duplicates(odd, words=2).collect()
    assert len(rows) == 6
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True),
    ]
    assert near_duplicates(nothing).collect() == []
    assert keep_one(odd).columns == odd.columns
    assert {(r._gone, r.doc) for r in keep_one(odd).collect()} == {("_gone", "doc")}


def test_one_row_of_each_group_is_left(spark, odd, docs, corpus):
    rows = sorted((r.doc_id or 0, r.text or "") for r in keep_one(odd, words=2).collect())
    assert rows == [(0, ""), (1, "a b c d e f g"), (2, "quite another text here")]
    assert len(keep_one(odd, words=2).where("n IS NULL").collect()) == 1
    some = [(None, "x y z"), (None, "X y z"), (None, "p q r"), (None, ""), (7, ""), (7, ""), (8, "k l m"), (8, "K l m"), (8, "p q r s")]
    frame = spark.createDataFrame(some, "doc_id int, text string").repartition(3)
    left = sorted((r.doc_id or 0, r.text.lower()) for r in keep_one(frame, words=2).collect())
    assert left == [(0, ""), (0, "p q r"), (0, "x y z"), (7, ""), (7, ""), (8, "k l m"), (8, "p q r s")]
    want = {doc for doc, (_, _, kept) in near_by_pairs(corpus, 5).items() if kept}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(want)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 70)] + [(200 + i, 200) for i in range(9)] + [(5, 5), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(71)} | {200 + i: 200 for i in range(9)} | {300: 300, 301: 300}


def test_shingles_of_one_text_do_not_depend_on_its_neighbours():
    texts = [b"a b c", b"", b"A  B\tc", b"one", b"a b", b" a b c d "]
    alone = [shingle_sets([t], 3) for t in texts]
    values, sizes = shingle_sets(texts, 3)
    parts = np.split(values, np.cumsum(sizes)[:-1])
    assert all((a[0] == p).all() and len(a[0]) == len(p) for a, p in zip(alone, parts))
    assert (parts[0] == parts[2]).all() and len(parts[5]) == 2 and len(parts[1]) == 0


def by_windows(corpus):
    seen, out = set(), {}
    for doc, text, *_ in sorted(corpus):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for at in range(len(body) - 99):
            if body[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            else:
                seen.add(body[at : at + 100])
        spans = sum(bool(g) and not (at and gone[at - 1]) for at, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[doc] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_all_windows(docs, corpus):
    cut = cut_repeats(docs).select("doc_id", "_cut.*").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in cut}
    want = by_windows(corpus)
    assert got == want
    assert sum(removed for _, removed, _, _ in want.values()) > 5000


def test_crowded_anchors_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr("pairwright.llm.suffix.MANY", 3)
    rng = random.Random(5)
    core = "".join(rng.choices("abcdefgh", k=110))
    rows = []
    for doc in range(60):
        left, right = "".join(rng.choices("xyz", k=2)) * 60, "".join(rng.choices("uvw", k=2)) * 60
        lo, hi = rng.randint(0, 40), rng.randint(70, 110)
        rows.append((doc, left + core[lo:hi] + right))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cut = cut_repeats(frame).select("doc_id", "_cut.*").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in cut}
    assert got == by_windows(rows)


def test_repeats_of_odd_rows(spark, odd, nothing):
    assert cut_repeats(odd).columns == [*odd.columns, "__cut"]
    assert without_repeats(odd).columns == odd.columns
    assert sorted(map(str, without_repeats(odd).collect())) == sorted(map(str, odd.collect()))
    assert cut_repeats(nothing).collect() == []
    long = "".join(random.Random(1).choices("abcdefghij", k=300))
    rows = [(1, long), (1, long), (2, long), (None, long), (0, None)]
    got = cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "_cut.n_removed").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [
        (False, 0, 0), (False, 1, 0), (False, 1, 0), (False, 2, 300), (True, 0, 300),
    ]


def test_half_characters_go_with_a_cut(spark):
    body = "ä" * 3 + "".join(random.Random(2).choices("äöü", k=120))
    rows = [(1, body), (2, "x" + body[1:] + "é")]
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == body and got[2] == "xé"


def test_contexts_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (50, 100, 99, 101, 400_000, 131_072, 131_073, 3, 0, 90_000, 90_000)]
    together = Contexts(texts)
    for i, text in enumerate(texts):
        alone, mine = Contexts([text]), together.text == i
        assert (alone.name == together.name[mine]).all() and (alone.start == together.start[mine]).all()
        assert alone.windows.sum() == max(0, len(text) - 99)


def whole(text, at):
    end = at + int(np.flatnonzero(text[at:] == 0)[0])
    return text[at : end + 1].tolist()


@pytest.mark.parametrize("short, held", [(1 << 20, 1 << 20), (3, 8), (3, 1 << 20)])
def test_induced_sorting_with_recursion_and_spills(short, held):
    rng = np.random.default_rng(0)
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 7)):
            parts += [*rng.integers(1, rng.integers(2, 6), rng.integers(1, 40)), 0]
        parts += parts
        text = np.array(parts, np.uint16)
        batches = list(induced.sorted_suffixes(text, 10, short, held))
        at = np.concatenate([p for p, _ in batches])
        common = np.concatenate([q for _, q in batches])
        assert sorted(at.tolist()) == np.flatnonzero(text != 0).tolist()
        suffixes = [whole(text, i) for i in at]
        assert suffixes == sorted(suffixes, reverse=True)
        for a, b, n in zip(suffixes, suffixes[1:], common[1:].tolist()):
            want = 0
            while want < 10 and a[want] == b[want] and a[want]:
                want += 1
            assert n == want


def test_names_are_shared_by_equal_sets_only(docs):
    signed = minhash._signed(docs.select("doc_id", "text"), 2).collect()
    by_class = defaultdict(set)
    for r in signed:
        by_class[r["class"]].add(tuple(r.signature))
    assert all(len(s) == 1 for c, s in by_class.items() if c is not None)
