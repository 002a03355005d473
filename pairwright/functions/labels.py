"""Three-class labels, probabilities and row losses (a wins, b wins, tie)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.schemas import LABEL_COLUMNS

# Fixed value: machine epsilon of 32-bit floats, the default clip of log loss.
FLOAT32_EPSILON = 1.1920928955078125e-07


def label_columns() -> list[Column]:
    return [F.col(name) for name in LABEL_COLUMNS]


def label_vector(labels: Sequence[Column] | None = None) -> Column:
    """(a, b, tie) as an array of doubles."""
    return F.array(*[one.cast("double") for one in labels or label_columns()])


def label_index(labels: Sequence[Column] | None = None) -> Column:
    """Position of the biggest label; the first wins among equals."""
    vector = label_vector(labels)
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Probabilities; the biggest logit is taken off first, so nothing overflows."""
    top = F.greatest(*logits)
    powers = [F.exp(one - top) for one in logits]
    total = reduce(add, powers)
    return [one / total for one in powers]


def log_softmax(logits: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logits)
    spread = F.log(reduce(add, [F.exp(one - top) for one in logits]))
    return [one - top - spread for one in logits]


def row_log_loss(
    labels: Sequence[Column], probabilities: Sequence[Column], eps: float = FLOAT32_EPSILON
) -> Column:
    """-sum of label * ln(probability clipped to [eps, 1 - eps])."""
    clipped = [F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), one)) for one in probabilities]
    return -reduce(add, [label * F.log(one) for label, one in zip(labels, clipped)])


def row_cross_entropy(labels: Sequence[Column], logits: Sequence[Column]) -> Column:
    """Cross entropy of soft labels against logits."""
    return -reduce(add, [label * one for label, one in zip(labels, log_softmax(logits))])
