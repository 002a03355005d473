"""Mirrors and template variants. All narrow: one scan, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import label_vector
from pairwright.functions.templates import (
    MARKUP,
    ChatMarkup,
    Template,
    bodies,
    chat_frame,
    judge_text,
    judged_length,
    literals_around,
    turn_tokens,
)
from pairwright.functions.text import WHITESPACE, Tokens
from pairwright.schemas import LABEL_COLUMNS, TURN_COLUMNS

_MIRRORED = (
    ("model_a", "model_b"),
    ("response_a", "response_b"),
    ("winner_model_a", "winner_model_b"),
)


def _pick(swapped: Column, own: str, other: str) -> Column:
    return F.when(swapped, F.col(other)).otherwise(F.col(own))


def swap_sides(df: DataFrame, swapped: Column) -> DataFrame:
    """Exchange A and B where `swapped` holds; prompt and tie stay."""
    present = [pair for pair in _MIRRORED if set(pair) <= set(df.columns)]
    columns = {}
    for a, b in present:
        columns[a] = _pick(swapped, a, b)
        columns[b] = _pick(swapped, b, a)
    return df.withColumns(columns)


def swap_augment(pairs: DataFrame, include_swap: bool = True) -> DataFrame:
    """Each row, and its mirror as a second row; `swapped` tells them apart."""
    flags = F.array(F.lit(False), F.lit(True)) if include_swap else F.array(F.lit(False))
    doubled = pairs.withColumn("swapped", F.explode(flags))
    return swap_sides(doubled, F.col("swapped"))


def fan_out(pairs: DataFrame, templates: Sequence[str]) -> DataFrame:
    """Each row once per template. `variant_no` puts originals before mirrors."""
    named = F.array(
        *[
            F.struct(F.lit(number).alias("template_no"), F.lit(name).alias("template"))
            for number, name in enumerate(templates)
        ]
    )
    widened = pairs.select("*", F.inline(named))
    first = F.when(F.col("swapped"), len(templates)).otherwise(0)
    return widened.withColumn("variant_no", first + F.col("template_no")).drop("template_no")


def tokenized_variants(
    templates: Sequence[Template],
    include_swap: bool,
    max_length: int | None,
    system_role: bool,
    markup: ChatMarkup,
    tokens: Tokens,
    texts: bool,
) -> Column:
    """Per variant, originals first, the text (if `texts`) and its token count, by a tokenizer of the user's.

    One Arrow pass over a row: the bodies of all variants are put together in the JVM, and cut, framed and counted in
    Python, where every distinct text of a batch of rows is cut once per limit and counted once.
    """
    prompt, a, b = (F.col(name) for name in TURN_COLUMNS)
    rendered: list[Column] = []
    # Of each variant: limit of a side, literals around the bodies, and where these are among the rendered ones.
    variants: list[tuple[int | None, list[str], list[int]]] = []
    for swapped in (False, True) if include_swap else (False,):
        for template in templates:
            before, after = chat_frame(template, system_role, markup)
            around = literals_around(template)
            parts = bodies(template, prompt, *((b, a) if swapped else (a, b)))
            variants.append(
                (
                    None if max_length is None else template.side_limit(max_length),
                    [before + around[0], *around[1:-1], around[-1] + after],
                    list(range(len(rendered), len(rendered) + len(parts))),
                )
            )
            rendered += parts
    tokenizer, width = tokens.batch, len(rendered)

    def run(found: pa.Array) -> pa.Array:
        given = found.flatten().to_pylist()
        rows = len(found)
        cut: dict[tuple[int | None, str], str] = {}
        for limit in {limit for limit, _, _ in variants if limit is not None}:
            asked = {given[row * width + at] for row in range(rows) for own, _, ats in variants if own == limit for at in ats}
            asked.discard(None)
            whole = list(asked)
            if whole:
                cut.update(zip([(limit, text) for text in whole], tokenizer(pd.Series(whole), limit)[0].tolist()))
        framed: list[str | None] = []
        for row in range(rows):
            for limit, around, ats in variants:
                parts = [given[row * width + at] for at in ats]
                if any(part is None for part in parts):
                    framed.append(None)
                    continue
                out = [around[0]]
                for part, literal in zip(parts, around[1:]):
                    out += [part if limit is None else cut[limit, part], literal]
                framed.append("".join(out))
        distinct = list(dict.fromkeys(text for text in framed if text is not None))
        counts = dict(zip(distinct, tokenizer(pd.Series(distinct), None)[1].tolist())) if distinct else {}
        shown = pa.array(framed if texts else [None] * len(framed), pa.string())
        lengths = pa.array([None if text is None else counts[text] for text in framed], pa.int32())
        made = pa.StructArray.from_arrays([shown, lengths], names=["text", "n_tokens"])
        return pa.ListArray.from_arrays(pa.array(range(0, (rows + 1) * len(variants), len(variants)), pa.int32()), made)

    return F.arrow_udf(run, "array<struct<text: string, n_tokens: int>>")(F.array(*rendered))


def sample_texts(
    pairs: DataFrame,
    templates: Sequence[Template],
    include_swap: bool = True,
    max_length: int | None = None,
    system_role: bool = False,
    markup: ChatMarkup = MARKUP,
    tokens: Tokens = WHITESPACE,
) -> DataFrame:
    """Samples with their text: (…pair columns, swapped, template, variant_no, input_text, label).

    With a tokenizer of the user's a row's variants are cut in one pass over it, before it is fanned out.
    """
    names = [one.name for one in templates]
    if tokens.batch is not None:
        made = tokenized_variants(templates, include_swap, max_length, system_role, markup, tokens, texts=True)
        variants = fan_out(swap_augment(pairs.withColumn("_made", made), include_swap), names)
        text = F.get("_made", F.col("variant_no"))["text"]
        return variants.withColumns({"input_text": text, "label": label_vector()}).drop("_made")
    variants = fan_out(swap_augment(pairs, include_swap), names)
    sides = [F.col("prompt"), F.col("response_a"), F.col("response_b")]
    text = F.coalesce(
        *[
            F.when(
                F.col("template") == one.name,
                judge_text(one, *sides, max_length, system_role, markup, tokens),
            )
            for one in templates
        ]
    )
    return variants.withColumns({"input_text": text, "label": label_vector()})


def variant_texts(
    templates: Sequence[Template],
    include_swap: bool = True,
    max_length: int | None = None,
    system_role: bool = False,
    markup: ChatMarkup = MARKUP,
    tokens: Tokens = WHITESPACE,
) -> Column:
    """The texts of all variants of a pair, by `variant_no`: what `sample_texts` has in rows of their own."""
    if tokens.batch is not None:
        made = tokenized_variants(templates, include_swap, max_length, system_role, markup, tokens, texts=True)
        return F.transform(made, lambda one: one["text"])
    prompt, a, b = (F.col(name) for name in TURN_COLUMNS)
    return F.array(
        *[
            judge_text(template, prompt, *((b, a) if swapped else (a, b)), max_length, system_role, markup, tokens)
            for swapped in ((False, True) if include_swap else (False,))
            for template in templates
        ]
    )


# What rendering makes of a row's turns, counted.
TURN_COUNTS = ("n_turns", "prompt_tokens", "a_tokens", "b_tokens")


def with_turn_counts(pairs: DataFrame) -> DataFrame:
    """Whitespace token counts of the turns that are rendered; one count serves all recipes."""
    turns = F.least(F.size("prompt"), F.size("response_a"), F.size("response_b"))
    counted = pairs.withColumn("n_turns", turns)
    return counted.withColumns(
        {
            name: turn_tokens(F.col(column), F.col("n_turns"))
            for name, column in zip(TURN_COUNTS[1:], TURN_COLUMNS)
        }
    )


def with_sample_lengths(
    pairs: DataFrame,
    templates: Sequence[Template],
    include_swap: bool = True,
    max_length: int | None = None,
    system_role: bool = False,
    markup: ChatMarkup = MARKUP,
    keep: Sequence[str] = ("row_id",),
    tokens: Tokens = WHITESPACE,
) -> DataFrame:
    """One row per source row with its `samples`, measured but without text.

    Batches are planned from a few numbers per sample; no text is moved by the
    shuffles after this. Whitespace tokens add up, so each turn is counted once
    for all variants, and no prompt is put together; rows that bring the
    columns of `with_turn_counts` are not counted again. With another tokenizer
    the texts are put together and counted, all variants of a row in one pass.
    """
    adds_up = tokens is WHITESPACE
    if adds_up:
        counted = pairs if set(TURN_COUNTS) <= set(pairs.columns) else with_turn_counts(pairs)
    elif tokens.batch is not None:
        made = tokenized_variants(templates, include_swap, max_length, system_role, markup, tokens, texts=False)
        counted = pairs.withColumn("_made", made)
    else:
        counted = pairs
    winner_a, winner_b, tie = (F.col(name) for name in LABEL_COLUMNS)
    variants = []
    for swapped in (False, True) if include_swap else (False,):
        answers = [F.col(c) for c in (TURN_COUNTS[2:] if adds_up else TURN_COLUMNS[1:])]
        winners = [winner_a, winner_b]
        if swapped:
            answers.reverse()
            winners.reverse()
        for template in templates:
            if adds_up:
                length = judged_length(
                    template,
                    F.col("n_turns"),
                    F.col("prompt_tokens"),
                    *answers,
                    max_length=max_length,
                    system_role=system_role,
                    markup=markup,
                )
            elif tokens.batch is not None:
                length = F.get("_made", F.lit(len(variants)))["n_tokens"]
            else:
                length = tokens.count(
                    judge_text(
                        template, F.col("prompt"), *answers, max_length, system_role, markup, tokens
                    )
                )
            variants.append(
                F.struct(
                    F.lit(len(variants)).alias("variant_no"),
                    F.lit(swapped).alias("swapped"),
                    F.lit(template.name).alias("template"),
                    label_vector([*winners, tie]).alias("label"),
                    length.alias("seq_len"),
                )
            )
    return counted.select(*keep, F.array(*variants).alias("samples"))


def flatten_samples(rows: DataFrame) -> DataFrame:
    """One row per sample."""
    return rows.select("*", F.inline("samples")).drop("samples")
