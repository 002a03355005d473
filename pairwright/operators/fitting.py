"""A preference classifier that Spark itself trains."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import WORD
from pairwright.schemas import LABEL_COLUMNS, PROBABILITY_COLUMNS


@dataclass(frozen=True)
class FitSettings:
    """`features` bounds what the driver holds: 3 x (2 x features + 2) coefficients."""

    features: int = 1 << 10
    steps: int = 25
    penalty: float = 0.01


def _with_words(pairs: DataFrame) -> DataFrame:
    columns = {}
    for side in "ab":
        text = F.array_join(f"response_{side}", "\n", "null")
        words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
        columns[f"_words_{side}"] = words
        columns[f"_size_{side}"] = F.log1p(F.size(words).cast("double"))
    return pairs.withColumns(columns)


def weighted_classes(pairs: DataFrame) -> DataFrame:
    """Soft labels as up to three weighted rows: the same loss as soft cross entropy."""
    weighted = F.array(
        *[
            F.struct(
                F.lit(float(number)).alias("_class"), F.col(name).cast("double").alias("_weight")
            )
            for number, name in enumerate(LABEL_COLUMNS)
        ]
    )
    return pairs.select("*", F.inline(weighted)).where(F.col("_weight") > 0)


def fit_preference(pairs: DataFrame, settings: FitSettings = FitSettings()) -> PipelineModel:
    """Three-class model on hashed words and lengths of both answers.

    The optimizer passes over the rows `steps` times, so hand in a staged table
    rather than a long plan.
    """
    stages = [
        HashingTF(
            inputCol=f"_words_{side}", outputCol=f"_hashed_{side}", numFeatures=settings.features
        )
        for side in "ab"
    ]
    stages.append(
        VectorAssembler(
            inputCols=["_hashed_a", "_hashed_b", "_size_a", "_size_b"], outputCol="_features"
        )
    )
    stages.append(
        LogisticRegression(
            featuresCol="_features",
            labelCol="_class",
            weightCol="_weight",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            predictionCol="_predicted",
            family="multinomial",
            maxIter=settings.steps,
            regParam=settings.penalty,
        )
    )
    # Words first: a soft-labelled row is split into classes after its texts are.
    worded = _with_words(pairs.select("response_a", "response_b", *LABEL_COLUMNS))
    return Pipeline(stages=stages).fit(
        weighted_classes(worded.drop("response_a", "response_b"))
    )


def gradient_norms(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """(part, n, worst): per part of the model, its coefficients and the largest slope of the fitted loss along one.

    The loss is the mean soft cross entropy of `pairs` plus the penalty on coefficients scaled by their
    features' deviation. At its optimum all slopes are 0, whatever the optimizer did, so this tells a fit that ended
    from one that was cut short. One pass over the pairs; sums per feature are combined before they are moved.
    """
    fitted = model.stages[-1]
    penalty, width = fitted.getOrDefault("regParam"), fitted.numFeatures
    scored = model.transform(_with_words(pairs.select("response_a", "response_b", *LABEL_COLUMNS)))
    probabilities = vector_to_array("_probability")
    over = F.array(*[F.get(probabilities, F.lit(i)) - F.col(name) for i, name in enumerate(LABEL_COLUMNS)])
    # Behind the features a constant one for the intercepts.
    features = F.concat(vector_to_array("_features"), F.array(F.lit(1.0)))
    rows = scored.select(over.alias("over"), F.posexplode(features).alias("at", "x"), *LABEL_COLUMNS).where("x <> 0")
    weight = reduce(add, [F.col(name) for name in LABEL_COLUMNS])
    squares = reduce(add, [F.col(name) * F.col(name) for name in LABEL_COLUMNS])
    sums = rows.groupBy("at").agg(
        *[F.sum(F.col("over")[i] * F.col("x")).alias(f"slope_{i}") for i in range(len(LABEL_COLUMNS))],
        F.sum(weight * F.col("x")).alias("first"),
        F.sum(weight * F.col("x") * F.col("x")).alias("second"),
    )
    whole = pairs.agg(F.sum(weight).alias("n"), F.sum(squares).alias("squares")).first()
    # As many rows as the model has features.
    matrix = fitted.coefficientMatrix.toArray()
    held = pairs.sparkSession.createDataFrame(
        [(at, *[float(c) for c in matrix[:, at]]) for at in range(width)] + [(width, 0.0, 0.0, 0.0)],
        "at int, w_0 double, w_1 double, w_2 double",
    )
    n = F.lit(whole["n"])
    # The weighted sample variance, as features are scaled by.
    variance = (F.col("second") - F.col("first") * F.col("first") / n) / (n - whole["squares"] / n)
    slopes = [
        F.abs(F.col(f"slope_{i}") / n + penalty * F.when(F.col("at") < width, variance).otherwise(0.0) * F.col(f"w_{i}"))
        for i in range(len(LABEL_COLUMNS))
    ]
    # A slope is held against the scale of its feature. What is the same in all rows has no coefficient.
    varies = (F.col("at") == width) | (variance > 1e-9 * F.col("second") / n)
    scale = F.when(F.col("at") < width, F.sqrt(F.abs(variance))).otherwise(1.0)
    half = (width - 2) // 2
    part = (
        F.when(F.col("at") < half, "words_a")
        .when(F.col("at") < 2 * half, "words_b")
        .when(F.col("at") == 2 * half, "size_a")
        .when(F.col("at") == 2 * half + 1, "size_b")
        .otherwise("intercepts")
    )
    return (
        sums.join(F.broadcast(held), "at")
        .select(part.alias("part"), F.when(varies, F.greatest(*slopes) / scale).otherwise(0.0).alias("slope"))
        .groupBy("part")
        .agg((F.count("*") * len(LABEL_COLUMNS)).alias("n"), F.max("slope").alias("worst"))
    )


def predict_preference(
    model: PipelineModel, pairs: DataFrame, name: str, row_id: str = "row_id"
) -> DataFrame:
    """(row_id, scorer, three probabilities) of a fitted model."""
    scored = model.transform(_with_words(pairs))
    values = vector_to_array(F.col("_probability"))
    return scored.select(
        F.col(row_id).alias("row_id"),
        F.lit(name).alias("scorer"),
        *[F.get(values, F.lit(i)).alias(column) for i, column in enumerate(PROBABILITY_COLUMNS)],
    )
