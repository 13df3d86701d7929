"""Decimals with their literal ``99.99m``, as Spark decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERAL = r"\A(-?\d+(?:\.\d+)?)m\z"


def is_decimal_literal(c: Column) -> Column:
    return c.rlike(_LITERAL)


def parse_decimal_literal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    """The literal's value, or null where it is none or does not fit."""
    digits = F.regexp_extract(c, _LITERAL, 1)
    return F.when(digits != "", digits).try_cast(f"decimal({precision},{scale})")


def decimal_literal(c: Column) -> Column:
    """A decimal's literal, without needless zeros."""
    s = c.cast("string")
    return F.concat(F.when(s.contains("."), F.regexp_replace(s, r"\.?0+\z", "")).otherwise(s), F.lit("m"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
