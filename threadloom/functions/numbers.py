"""Lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import strip

_INT = r"\A[+-]?[0-9]+\z"
_FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def safe_int(c: Column, default: int = 0) -> Column:
    """``"1,234"``, ``"1.5K"`` and ``"2M"`` as whole numbers."""
    text = F.translate(strip(c), ", ", "")
    unit = F.upper(F.right(text, F.lit(1)))
    head = F.substring(text, F.lit(1), F.length(text) - 1)
    scaled = F.when(F.rlike(head, F.lit(_FLOAT)), head.try_cast("double"))
    value = (
        F.when(unit == "K", (scaled * 1000).cast("long"))
        .when(unit == "M", (scaled * 1000000).cast("long"))
        .when(F.rlike(text, F.lit(_INT)), text.try_cast("long")))
    return F.coalesce(value, F.lit(default).cast("long"))


def safe_float(c: Column, default: float = 0.0) -> Column:
    text = strip(c)
    return F.coalesce(F.when(F.rlike(text, F.lit(_FLOAT)), text.try_cast("double")),
                      F.lit(default))


def meta_text(c: Column) -> Column:
    """Metadata value as trimmed text, null as ""."""
    return F.coalesce(strip(c), F.lit(""))


def meta_int(c: Column) -> Column:
    """The same value as a whole number where it is one."""
    text = meta_text(c)
    return F.when(F.rlike(text, F.lit(r"\A-?[0-9]+\z")), text.try_cast("long"))
