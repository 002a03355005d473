"""Explicit schemas. Readers never infer."""

from pyspark.sql import types as T

LABEL_COLUMNS = ("winner_model_a", "winner_model_b", "winner_tie")
TURN_COLUMNS = ("prompt", "response_a", "response_b")

TURNS = T.ArrayType(T.StringType())
CONVERSATION = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_WINNERS = tuple((name, T.DoubleType()) for name in LABEL_COLUMNS)

# A labelled pair as Spark works on it: one list item per turn.
PAIR = _struct(
    ("id", T.StringType()),
    ("model_a", T.StringType()),
    ("model_b", T.StringType()),
    ("prompt", TURNS),
    ("response_a", TURNS),
    ("response_b", TURNS),
    *_WINNERS,
)

# The same pair at rest: the three lists are JSON text.
PAIR_TEXT = _struct(
    ("id", T.StringType()),
    ("model_a", T.StringType()),
    ("model_b", T.StringType()),
    ("prompt", T.StringType()),
    ("response_a", T.StringType()),
    ("response_b", T.StringType()),
    *_WINNERS,
)

FOLD = T.StructField("fold", T.IntegerType())
ROW_KEY = T.StructField("row_id", T.StringType())

CHAT_LOG = _struct(("model", T.StringType()), ("conversation", CONVERSATION))

CORPUS = _struct(("row_id", T.StringType()), ("chosen", CONVERSATION), ("rejected", CONVERSATION))

PREDICTION = _struct(
    ("row_id", T.StringType()),
    ("scorer", T.StringType()),
    ("p_a", T.DoubleType()),
    ("p_b", T.DoubleType()),
    ("p_tie", T.DoubleType()),
)
PROBABILITY_COLUMNS = ("p_a", "p_b", "p_tie")
