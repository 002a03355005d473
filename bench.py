"""Seconds per registered query at one scale, as one JSON line.

Every query is run in full: all rows, all columns, to a sink that drops them.
A few run beforehand without the clock, so that it does not time the JVM's start.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from pairwright.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UP = ("pair_mining", "fold_assignment", "batch_plan", "rolling_loss", "ensemble_mean")


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        app="bench",
        master=f"local[{CPUS}]",
        shuffle_partitions=8 if CPUS == "*" else int(CPUS),
        extra={
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    for name in WARM_UP:
        run(QUERIES[name], spark)
    seconds = {name: round(run(QUERIES[name], spark), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds over all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(SF_DIR).name.removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
