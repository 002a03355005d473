"""Turn lists: JSON text, equality keys, role filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_turns(turns: Column) -> Column:
    """List of turns to JSON text; a null turn stays null."""
    return F.to_json(turns)


def decode_turns(text: Column) -> Column:
    """JSON text to list of turns. Text that is no such list ends the job; a null stays null."""
    return F.from_json(text, "array<string>", {"mode": "FAILFAST"})


def digest(text: Column) -> Column:
    """32-byte key of a text.

    Shuffles move this instead of the text. `mine_pairs` still compares the
    real prompts of each pair once their texts are fetched. A null has the empty
    key: a column that is never null spares joins a second hashing of the text
    just to look for nulls.
    """
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(bytearray()))


def turns_key(turns: Column) -> Column:
    """Whole-list equality key, the same whatever spacing the JSON on disk had."""
    return digest(encode_turns(turns))


def key_text(key: Column) -> Column:
    """Printable form of a key."""
    return F.lower(F.hex(key))


def texts_of(conversation: Column, role: str) -> Column:
    """The texts one role wrote, in order."""
    return F.transform(
        F.filter(conversation, lambda turn: turn["role"] == role), lambda turn: turn["content"]
    )


def seeded_hash(seed: int, row_id: Column) -> Column:
    """32 hex digits that depend on the seed and the row only, never on row order.

    A null key ends the job: all such rows would hash alike.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), present_key(row_id)))


def present_key(row_id: Column) -> Column:
    """A row key as text; a null one ends the job."""
    stop = F.raise_error(F.lit("row without a key")).cast("string")
    return F.when(row_id.isNull(), stop).otherwise(row_id.cast("string"))
