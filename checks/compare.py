"""Run registered queries and their SQL twins side by side: `python -m checks.compare SF_DIR [name …]`."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from checks.oracles import ORACLES
from checks.queries import QUERIES
from pairwright.session import build_session


def _plain(value: object) -> object:
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return str(value)


def rows_of(frame: pd.DataFrame) -> Counter:
    ordered = frame[sorted(frame.columns)]
    return Counter(
        tuple(_plain(value) for value in row) for row in ordered.itertuples(index=False, name=None)
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


# Spark type -> type the SQL twin must have.
_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def type_difference(frame: DataFrame, relation: duckdb.DuckDBPyRelation) -> str | None:
    """Columns whose types differ, or None."""
    ours = {name: _TYPES.get(kind, kind) for name, kind in frame.dtypes}
    theirs = {name: str(kind) for name, kind in zip(relation.columns, relation.types)}
    unlike = {name: (ours.get(name), kind) for name, kind in theirs.items() if ours.get(name) != kind}
    return f"types {unlike}" if unlike else None


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs between two results, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    left, right = rows_of(ours), rows_of(theirs)
    if left != right:
        only_ours, only_theirs = left - right, right - left
        shown = [str(next(iter(side.items()), None))[:400] for side in (only_ours, only_theirs)]
        return (
            f"rows {len(ours)} against {len(theirs)}; {sum(only_ours.values())} only here,"
            f" {sum(only_theirs.values())} only there\n    {shown[0]}\n    {shown[1]}"
        )
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        master="local[8]",
        shuffle_partitions=8,
        extra={"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in names or list(QUERIES):
        start = time.time()
        frame = QUERIES[name](spark, sf_dir)
        ours = frame.toPandas()
        seconds = time.time() - start
        if name not in ORACLES:
            print(f"{name:24s} {len(ours):7d} rows only   {seconds:6.2f}s", flush=True)
            continue
        start = time.time()
        relation = connection.sql(ORACLES[name])
        theirs = relation.df()
        twin = time.time() - start
        found = type_difference(frame, relation) or difference(ours, theirs)
        failures += found is not None
        verdict = "ok" if found is None else f"DIFFERS {found}"
        print(
            f"{name:24s} {len(ours):7d} {seconds:6.2f}s sql {twin:6.2f}s {verdict}", flush=True
        )
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
