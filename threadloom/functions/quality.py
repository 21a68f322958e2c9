"""Chunk quality predicates and metadata filters as column expressions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions.text import WORD_SET, WS, WS_SET, contains_any, empty_if_null, strip


def long_enough(c: Column, min_length: int = 50) -> Column:
    return F.length(strip(empty_if_null(c))) >= min_length


def is_table_rule(c: Column) -> Column:
    """A markdown table rule on a line of its own."""
    cell = f"[{WS_SET}\\-:]"
    return F.rlike(c, F.lit(f"\\A\\|{cell}+\\|{cell}*\\|?{cell}*\\|?[^\\n]*\\n?\\z"))


def _left(c: Column, removed: str) -> Column:
    """Characters left when all of a set are taken out; cheaper than listing matches."""
    return F.length(F.regexp_replace(c, f"[{removed}]+", ""))


def formatting_ratio(c: Column) -> Column:
    n = F.length(c) - _left(c, f"|\\-{WS_SET}:")
    return F.when(F.length(c) > 0, n / F.length(c)).otherwise(0.0)


def ascii_words(c: Column) -> Column:
    """Whole words made of ASCII letters and digits only."""
    return F.regexp_count(
        c, F.lit(f"(?<![{WORD_SET}])[a-zA-Z0-9]++(?![{WORD_SET}])"))


def punctuation_ratio(c: Column) -> Column:
    solid = _left(c, WS_SET)
    marks = _left(c, WORD_SET + WS_SET)
    return F.when(solid > 0, marks / solid).otherwise(0.0)


def is_valid_chunk(c: Column, min_length: int = fv.CHUNK_MIN_CHARS,
                   min_words: int = fv.CHUNK_MIN_WORDS) -> Column:
    text = empty_if_null(c)
    return (
        (F.length(text) >= min_length)
        & ~is_table_rule(text)
        & (formatting_ratio(text) <= fv.FORMATTING_RATIO)
        & (ascii_words(text) >= min_words)
        & (punctuation_ratio(text) <= fv.PUNCTUATION_RATIO))


def reject_reason(c: Column, min_length: int = fv.CHUNK_MIN_CHARS,
                  min_words: int = fv.CHUNK_MIN_WORDS) -> Column:
    """Why a chunk is refused; null for a valid one."""
    text = empty_if_null(c)
    return (
        F.when(F.length(text) < min_length,
               F.concat(F.lit("Text too short (length: "), F.length(text).cast("string"),
                        F.lit(f", minimum: {min_length})")))
        .when(is_table_rule(text), "Table separator")
        .when(formatting_ratio(text) > fv.FORMATTING_RATIO, "Mostly formatting")
        .when(ascii_words(text) < min_words, "Too few words")
        .when(punctuation_ratio(text) > fv.PUNCTUATION_RATIO, "Mostly punctuation"))


def has_code(c: Column) -> Column:
    return contains_any(c, fv.CODE_MARKERS)


_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(v),
    "$nin": lambda c, v: ~c.isin(v),
}


def metadata_filter(spec: dict[str, Any] | None) -> Column:
    """A filter given as a dict of equalities, ranges, ``$and`` and ``$or``."""
    if not spec:
        return F.lit(True)
    terms = []
    for key, value in spec.items():
        if key == "$and":
            terms.append(reduce(lambda a, b: a & b, [metadata_filter(s) for s in value]))
        elif key == "$or":
            terms.append(reduce(lambda a, b: a | b, [metadata_filter(s) for s in value]))
        elif isinstance(value, dict):
            terms.extend(_COMPARE[op](F.col(key), v) for op, v in value.items())
        else:
            terms.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, terms)


def type_filter(kind: Column, types: list[str] | None) -> Column:
    """Rows of the wanted types; a row without a type counts as documentation."""
    if not types:
        return F.lit(True)
    return F.lower(F.coalesce(kind, F.lit("documentation"))).isin([t.lower() for t in types])


def relative_start(phrase: Column, as_of_epoch: float, recent_days: int = 30) -> Column:
    """Start of the time range a question asks for, null when it names none."""
    p = F.lower(phrase)
    day = 86400.0
    ago = lambda days: F.lit(as_of_epoch - days * day)
    return (
        F.when(F.contains(p, F.lit("last week")), ago(7))
        .when(F.contains(p, F.lit("last month")), ago(30))
        .when(F.contains(p, F.lit("last year")), ago(365))
        .when(contains_any(p, ["recent", "latest", "new", "current"]), ago(recent_days)))


def keep_video(seconds: Column, need_video: bool = False) -> Column:
    keep = seconds >= fv.MIN_VIDEO_SECONDS
    return keep & (seconds <= fv.MAX_VIDEO_SECONDS) if need_video else keep
