"""Spelling variants, the conversation trie and near vectors against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairwright.llm import trie
from pairwright.llm.projections import collided, least_count, near_vectors, table_plan
from pairwright.llm.spelling import MIN_LENGTH, signatures, spelling_variants, thinned
from pairwright.llm.trie import nested, prefix_trie, rebuilt

# Spelling


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def variants_by_edits(rows):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "").translate(lower) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                at = h % len(run)
                counts[run if h % 31 else run[:at] + run[at + 1 :]] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = sorted({c for w in words for c in w})
    near = {w: [o for o in edits(w, letters) if o in words] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    """Texts with words of three frequencies that are edits of each other, and letters beyond ASCII."""
    rng = random.Random(5)
    rows = []
    for number in range(40):
        word = "".join(rng.choices("abcdeéßÿ", k=rng.randint(7, 11)))
        chain = [word]
        for _ in range(2):
            chain.append(rng.choice(sorted(edits(chain[-1], "abcÀ"))))
        text = " ".join([chain[0]] * 230 + [chain[1]] * 21 + [chain[2].translate({ord(c): c.upper() for c in "abcde"})] * 2)
        rows.append((number, text + "-" + "".join(rng.choices("abé×÷ Z", k=300))))
    rows += [(None, "variants variants variant"), (41, None), (42, ""), (43, "x" * 4000 + " " + "Häuserß 1 häuserß"), (43, "häuserß")]
    return rows


def test_variants_equal_brute_force(spark, spelled):
    docs = spark.createDataFrame(spelled, "doc_id long, text string").repartition(4).selectExpr("*", "'x' AS word", "1 AS n", "'y' AS KEY")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(docs).collect()}
    want = variants_by_edits(spelled)
    assert got == want
    # Chains of two forms are among them, and words that many others are near to.
    assert any(f and r != f for f, r, *_ in want.values()) and max(n for *_, n, _ in want.values()) > 1


def test_words_at_one_edit_share_a_signature():
    rng = random.Random(3)
    elements = {}
    for _ in range(300):
        word = "".join(rng.choices("aabcé", k=rng.randint(7, 15)))
        keys = set(signatures(word, elements))
        for other in rng.sample(sorted(edits(word, "abz")), 10):
            theirs = signatures(other, elements)
            if len(other) == len(word):
                assert keys & {(side, key) for side, key in theirs if side == 0}
            else:
                short, long = sorted((signatures(word, elements), theirs), key=lambda s: s is theirs if len(other) > len(word) else s is not theirs)
                assert {key for side, key in short if side == 1} & {key for side, key in long if side == 2}


def test_thinned_words():
    runs = [f"word{n}" for n in range(400)]
    assert {len(r) - len(thinned(r, 7)) for r in runs} == {0, 1}
    assert MIN_LENGTH == 7


def test_no_words(spark, nothing):
    assert spelling_variants(nothing).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "a bc"), (2, None)], "doc_id long, text string")).count() == 0


# Trie


def trie_by_dicts(conversations):
    """{(depth, smallest member, ends): rest} of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, own in members.items():
        value = (len(own) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += value
    rows = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        rows.append((min(own), len(path), parent, len(own), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(rows)


def nodes_of(frame):
    return Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends) for r in frame.collect()
    )


def chatter(seed, n=260):
    """Conversations that share first turns of several depths; a third of them are one and the same."""
    rng = random.Random(seed)
    known = [[("user", "hello")]]
    out = {}
    for conv in range(n):
        if conv % 3 == 0:
            turns = [("user", "hello"), ("assistant", "hi"), ("user", "who?")]
        else:
            base = rng.choice(known)
            turns = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "assistant"]), rng.choice("abé😀") * rng.randint(0, 3)) for _ in range(rng.randint(0, 4))]
        known.append(turns)
        out[conv * 5000 + rng.randint(0, 3)] = turns
    out[7] = [("user", "t" * 50)] * 120
    return out


def long_form(spark, conversations):
    rows = [(conv, turn, role, text) for conv, turns in conversations.items() for turn, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def as_lists(spark, conversations):
    """`nested`, and the conversations without turns."""
    from pyspark.sql import functions as F

    made = nested(long_form(spark, conversations))
    bare = [(conv,) for conv, turns in conversations.items() if not turns]
    none = spark.createDataFrame(bare, "conv_id long").withColumn("turns", F.array().cast(made.schema["turns"].dataType))
    return made.unionByName(none)


@pytest.mark.parametrize("group_rows", [4096, 20, 2])
def test_trie_equals_brute_force(spark, monkeypatch, group_rows):
    """One group, one round of hot prefixes, and many."""
    monkeypatch.setattr(trie, "GROUP_ROWS", group_rows)
    conversations = chatter(2)
    assert nodes_of(prefix_trie(as_lists(spark, conversations))) == trie_by_dicts(conversations)


def test_rebuilt_conversations(spark):
    turns = {conv: [("user", f"{conv}/{t}") for t in range(conv % 9)] for conv in list(range(190, 310)) + [500, 501]}
    want = {}
    for conv, own in turns.items():
        if own:
            h = zlib.crc32(str(conv).encode()) % 6
            want[conv] = turns.get(conv - conv % 100, [])[:h] + own[h:]
    made = prefix_trie(rebuilt(nested(long_form(spark, turns))))
    assert nodes_of(made) == trie_by_dicts(want)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, None, None),  # a turn without number comes first, without role and text it is empty
        (1, 0, "user", "a"),
        (2, None, "", ""),
        (2, 5, "user", "a"),
        (None, 0, "user", "lost"),  # no conversation
        (3, 0, "user", "x" * 100_000),
        (3, 0, "user", "x" * 100_000),  # repeated rows are turns of their own
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path", "2 AS n", "'x' AS node")
    want = {1: [("", ""), ("user", "a")], 2: [("", ""), ("user", "a")], 3: [("user", "x" * 100_000)] * 2}
    assert nodes_of(prefix_trie(nested(frame))) == trie_by_dicts(want)
    # Role and text are kept apart.
    split = spark.createDataFrame([(1, 0, "us", "era"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert prefix_trie(nested(split)).count() == 3
    assert prefix_trie(nested(frame.where("false"))).count() == 0


# Vectors


def linked_by_pairs(rows, alike):
    def sound(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(k, np.array(v, float), label) for k, (_, v, label) in enumerate(rows) if sound(v, label)]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    degree = [0] * len(rows)
    for x, (a, u, la) in enumerate(ok):
        for b, v, lb in ok[x + 1 :]:
            if la == lb and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= alike:
                degree[a] += 1
                degree[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (vec, _, _) in enumerate(rows):
        if vec is not None:
            root = find(k)
            least[root] = min(least.get(root, vec), vec)
    return Counter((vec, degree[k], least.get(find(k)), least.get(find(k)) == vec) for k, (vec, _, _) in enumerate(rows))


def clustered(seed, n, dim=24):
    """Vectors of two labels: alone, in chains of near ones, in one large tight group, and copies."""
    rng = np.random.default_rng(seed)
    rows, last, tight = [], rng.standard_normal(dim), rng.standard_normal(dim)
    for k in range(n):
        if k % 3 == 0:
            v = tight + 0.05 * rng.standard_normal(dim)
        elif k % 3 == 1:
            v = rng.standard_normal(dim)
        else:
            v = last + 0.2 * rng.standard_normal(dim)
            last = v if k % 30 else rng.standard_normal(dim)
        rows.append((k + 10, [float(x) for x in v], int(k % 8 == 0)))
    rows += [(n + 20 + k, rows[3][1], rows[3][2]) for k in range(4)]
    return rows


@pytest.mark.parametrize("cell", [1024, 32])
def test_links_equal_all_pairs(spark, cell):
    """With small cells there are several tables, and the tight group is cut into blocks."""
    rows = clustered(4, 420)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(frame, cell=cell).collect())
    want = linked_by_pairs(rows, 0.93)
    # A link just at the cosine may be missed, with a chance of some thousandths; many are near it here.
    assert sum((got & want).values()) >= 0.9 * len(rows)
    assert sum(r[1] * n for r, n in got.items()) >= 0.995 * sum(r[1] * n for r, n in want.items())
    degrees = {r[0]: r[1] for r in want}
    assert all(r[1] <= degrees[r[0]] for r in got)
    assert max(degrees.values()) > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (2, [0.0, 1.0], 1),
        (3, [1.0, 0.1], 2),
        (4, [1.0, 0.0], None),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0], 1),
        (8, [1.0, None], 1),
        (9, [1.0, nan], 1),
        (10, [inf, 0.0], 1),
        (11, [1e300, 1e290], 1),
        (12, [1.0, 0.0, 0.0], 1),
        (None, [1.0, 0.0], 1),
        (None, None, 1),
        (13, [-1.0, -0.0], 1),
        (14, [-2.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS item", "1 AS unit", "2 AS code")
    got = Counter((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in near_vectors(frame).collect())
    want = linked_by_pairs(rows, 0.93)
    assert got == Counter({(v, d, c, c == v): n for (v, d, c, _), n in want.items()})
    assert near_vectors(frame.where("false")).count() == 0


def test_counts_are_calibrated():
    """Pairs just at the cosine are found as often as the counts promise, random ones hardly ever."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((500, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    units = np.concatenate([base, 0.93 * base + np.sqrt(1 - 0.93**2) * side])
    one, two = collided(units, 0.93)
    assert (one < two).all() and len(set(zip(one.tolist(), two.tolist()))) == len(one)
    assert ((two - one) == 500).sum() >= 496
    assert len(one) <= 700
    assert least_count(10, 0.5, 0.02) == 2 and table_plan(100, 0.93, 1024) == (0, 1)
    bits, tables = table_plan(50_000, 0.93, 1024)
    assert bits == 6 and (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= 2e-3
