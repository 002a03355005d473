import random

import pytest

# What the operators call columns of their own.
CLASHES = ("doc", "version", "_doc", "_cut", "_gone", "_firsts", "_found", "_places", "_N_CUT", "place", "line", "site", "start", "body", "kept", "to", "norm", "name")


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) with exact and near copies, shared lines and passages, empty, null and long texts."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgäß", k=rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    line = " ".join(rng.choices(words, k=9))
    rows = []
    for doc in range(240):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 14))) for _ in range(rng.randint(1, 9))]
        if doc % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), line)
        if doc % 11 == 0:
            lines.insert(0, passage)
        rows.append([doc, "\n".join(lines), f"site{rng.randint(0, 9)}"])
    for doc in range(240, 300):
        body = rows[rng.randint(0, 5) if doc % 2 else rng.randint(0, 239)][1].split(" ")
        for _ in range(rng.randint(0, 2 + len(body) // 25)):
            body[rng.randint(0, len(body) - 1)] = rng.choice(words)
        rows.append([doc, " ".join(body), "site0"])
    rows += [
        [300, None, "site1"],
        [301, "", "site1"],
        [302, " \t\n", None],
        [303, "one", "site2"],
        [304, "ONE", "site3"],
        [305, "one  two", "site2"],
        [306, "x" * 450, "site4"],
        [307, "ab" * 6000 + " " + passage, "site4"],
        [308, " ".join(rng.choices(words, k=5000)), "site5"],
        [309, line, "site5"],
        [310, "▁ <|endoftext|> it's 3.5€ \x00\x1c\x85 é😀  ", "site6"],
    ]
    rng.shuffle(rows)
    return [tuple(row) for row in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, a doc_id with two texts, null ids and columns with clashing names."""
    rows = [
        (1, "a b c d e f g", "s", 1, 1),
        (1, "a b c d e f g", "s", 1, 1),
        (2, "a b c d e f g", None, 1, 1),
        (2, "quite another text here", "s", 1, 1),
        (None, "a b c d e f g", "s", None, None),
        (None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int, n long")
    return frame.selectExpr("*", "'x' AS class", "'x' AS word", "'x' AS key", "1 AS part", "'x' AS _version", "'x' AS score", *[f"'{c}' AS {c}" for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
