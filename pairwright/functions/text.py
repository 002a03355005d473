"""Whitespace tokens.

Blank, tab, newline and carriage return part words; `\\s` is avoided because
engines differ on what else it takes in. `Tokens` is what rendering and measuring
ask of a tokenizer; sub-word ones come in through `operators.scoring.tokens_of`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns.
WORD = "[^ \t\n\r]+"
BLANKS = " \t\n\r"
GAP = "(?<=[^ \t\n\r])[ \t\n\r]+"


def count_words(text: str) -> int:
    """`token_count` of a literal."""
    return len(re.findall(WORD, text))


def token_count(text: Column) -> Column:
    """Number of whitespace tokens in the whole text."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truncate_tokens(text: Column, limit: int) -> Column:
    """The text up to its `limit`-th token; a text within the limit comes back as it is.

    The text is split at its first `limit` gaps only, so what lies behind them is not looked at: it is the last
    piece, and the cut is before the gap in front of it.
    """
    if limit == 0:
        # Without a token nothing is kept of a text that has some.
        return bind(text, lambda whole: F.when(whole.rlike(WORD), F.lit("")).otherwise(whole))

    def cut(whole: Column) -> Column:
        # A gap follows a token, so white space in front of the first one is none.
        pieces = F.split(whole, GAP, limit + 1)

        def kept(found: Column) -> Column:
            rest = F.get(found, F.lit(limit))
            # The gap itself is white space and does not belong to the last token kept.
            before = F.rtrim(F.left(whole, F.length(whole) - F.length(rest)), F.lit(BLANKS))
            return F.when(F.coalesce(rest, F.lit("")) == "", whole).otherwise(before)

        # n tokens take at least 2n - 1 characters, so short texts skip the regex.
        return F.when(F.length(whole) < 2 * limit, whole).otherwise(bind(pieces, kept))

    return bind(text, cut)


@dataclass(frozen=True)
class Tokens:
    """How texts are cut to a number of tokens, and how tokens are counted.

    `batch`, where there is one, does both for many texts at a time in Python: (texts, limit or none) to (texts cut
    to the limit, token counts of the whole texts). Samples are then cut and counted in one pass over a row.
    """

    cut: Callable[[Column, int], Column]
    count: Callable[[Column], Column]
    batch: Callable[[pd.Series, int | None], tuple[pd.Series, pd.Series]] | None = None


WHITESPACE = Tokens(truncate_tokens, token_count)
