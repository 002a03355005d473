"""Rows that pass a check and rows that do not, as two tables that add up to the input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairwright.staging import stage_path

# The folder column that parts the two.
_FIT = "_is_fit"


@dataclass(frozen=True)
class Split:
    """`fit` rows, `unfit` ones with their `reason`, and how many there are of each kind."""

    fit: DataFrame
    unfit: DataFrame
    n_fit: int
    n_unfit: int


def split_checked(checked: DataFrame, label: str = "checked") -> Split:
    """Part rows by their `reason`, null for fit ones, in one pass over the input.

    Both sides are written by the same job, which also counts what it reads; no row is moved. Ends with an error if
    the written sides do not add up to that.
    """
    seen = Observation(f"{label}-rows")
    observed = checked.observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("reason").isNotNull()).alias("n_unfit")
    )
    path = stage_path(checked.sparkSession, label)
    observed.withColumn(_FIT, F.col("reason").isNull()).write.partitionBy(_FIT).parquet(path)
    schema = checked.schema.add(_FIT, "boolean")
    written = checked.sparkSession.read.schema(schema).parquet(path)
    fit, unfit = written.where(_FIT).drop(_FIT, "reason"), written.where(~F.col(_FIT)).drop(_FIT)
    n_fit, n_unfit = fit.count(), unfit.count()
    if (n_fit + n_unfit, n_unfit) != (seen.get["n_rows"], seen.get["n_unfit"]):
        raise RuntimeError(f"{label}: {n_fit} and {n_unfit} rows written, {seen.get} read")
    return Split(fit, unfit, n_fit, n_unfit)
