import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from checks.compare import difference
from pairwright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    # Whole numbers stay such beside nulls.
    ours = QUERIES[name](spark, sf_dir).toArrow().to_pandas(integer_object_nulls=True)
    assert difference(ours, connection.sql(ORACLES[name]).df()) is None


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert len([name for name in names if re.match(rf"op{n}_", name)]) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Every stage against what it must do to its own input."""
    import numpy as np
    from test_exact_and_lines import cleaned
    from test_near_and_suffix import by_windows, near_by_pairs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns = docs.columns
    frames = [docs]
    for name, apply in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        apply(spark, frames[-1], sf_dir).write.parquet(path)
        frames.append(spark.read.parquet(path))
    assert all(frame.columns == columns for frame in frames[1:-1])
    start, good, lined, single, cut = ({r.doc_id: r for r in frame.collect()} for frame in frames[:-1])
    kept = [doc for doc, quality in labels.items() if quality == 1]
    assert sum(doc in good for doc in kept) >= 0.97 * len(kept) and all(start[doc] == row for doc, row in good.items())
    assert {d: r.text for d, r in lined.items()} == cleaned([(d, r.text, r.source) for d, r in good.items()], corpus_pipeline_min_sites())
    want = near_by_pairs([(d, r.text) for d, r in lined.items()], 5)
    assert single == {d: r for d, r in lined.items() if want[d][2]}
    spans = by_windows([(d, r.text) for d, r in single.items()])
    for doc, row in cut.items():
        assert row.n_chars == len(row.text)
        if not spans[doc][1]:
            assert row.text == single[doc].text
        else:
            assert len(row.text.encode()) <= spans[doc][0] - spans[doc][1]
    pieces = frames[-1].collect()
    assert {r.doc_id for r in pieces} == set(cut) and int(np.max([r.length for r in pieces])) <= 2048


def corpus_pipeline_min_sites():
    from pairwright.llm.lines import MIN_SITES

    return MIN_SITES
