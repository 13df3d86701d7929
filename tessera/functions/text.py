"""Column functions on text whose shape is known only at run time: Arrow batches through the readers and writers of ``values``.

Every function gives null for null. Where ``errors`` is "null" a bad text gives null, otherwise it raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import values
from ..plans.schema import Schema
from ..values import DEFAULT, Options


def mapped(fn: Callable[[Any], Any], kind: str = "string", errors: str = "null") -> Callable[[Column], Column]:
    """``fn`` on each value of a column, in Arrow batches."""

    def one(x: Any) -> Any:
        if x is None or isinstance(x, float) and x != x:
            return None
        try:
            return fn(x)
        except (ValueError, RecursionError):
            if errors != "null":
                raise
            return None

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([one(x) for x in s], dtype=object)

    return run


def from_json_text(c: Column, options: Options = DEFAULT, marker: str | None = None, errors: str = "null") -> Column:
    """JSON text as canonical loose text."""
    return mapped(lambda s: values.loose(values.from_json(s, marker), options), errors=errors)(c)


def to_json_text(c: Column, schema: Schema | None = None, marker: str | None = None, errors: str = "null") -> Column:
    """Loose, typed or packed text as JSON."""
    return mapped(lambda s: values.to_json(values.parse(s, schema=schema), marker), errors=errors)(c)


def canon_text(c: Column, options: Options = DEFAULT, typed_mode: bool = False, errors: str = "null") -> Column:
    """Any text of the format in canonical loose form."""
    return mapped(lambda s: values.loose(values.parse(s, typed_mode), options), errors=errors)(c)


def typed_form(c: Column, schema: Schema | None = None, errors: str = "null") -> Column:
    return mapped(lambda s: values.typed(values.parse(s, True, schema)), errors=errors)(c)


def fingerprint_text(c: Column, json: bool = False, errors: str = "null") -> Column:
    """SHA-256 of the canonical no-table form of a text, or of JSON."""
    read = values.from_json if json else values.parse
    return mapped(lambda s: values.fingerprint(read(s)), errors=errors)(c)


def patch_base_text(c: Column, json: bool = False, errors: str = "null") -> Column:
    read = values.from_json if json else values.parse
    return mapped(lambda s: values.patch_base(read(s)), errors=errors)(c)


def equal_text(a: Column, b: Column) -> Column:
    """Whether two texts mean the same value; null where either cannot be read."""
    return fingerprint_text(a) == fingerprint_text(b)


def json_equal(a: Column, b: Column) -> Column:
    return fingerprint_text(a, json=True) == fingerprint_text(b, json=True)


def parse_typed(c: Column, schema: Schema | None = None) -> Column:
    """Typed text read as far as it goes: struct of ``json``, ``errors`` and ``warnings``."""

    def one(s: str) -> dict:
        v, errors, warnings = values.parse_tolerant(s, schema)
        return {"json": None if errors else values.to_json(v), "errors": errors, "warnings": warnings}

    return _struct(one, "json string, errors array<string>, warnings array<string>")(c)


def _struct(fn: Callable[[Any], dict], ddl: str) -> Callable[[Column], Column]:
    @F.pandas_udf(ddl)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [None if x is None else fn(x) for x in s]
        names = [f.split()[0] for f in ddl.split(", ")]
        return pd.DataFrame({n: [None if r is None else r[n] for r in rows] for n in names}, dtype=object)

    return run


def key_dict(c: Column, json: bool = True) -> Column:
    """The sorted keys of each value."""
    read = values.from_json if json else values.parse
    return mapped(lambda s: values.key_dictionary(read(s)), "array<string>")(c)


def schema_context_id(keys: Column) -> Column:
    return mapped(lambda ks: values.schema_context_id(list(ks)))(keys)


def compact_keys(c: Column, keys: list[str], json: bool = True, header: bool = True) -> Column:
    """Keys of the dictionary written as ``#N``, after a header that gives them."""
    read = values.from_json if json else values.parse
    options = values.LLM.replace(keys=tuple(keys))
    write = values.loose_with_schema if header else values.loose
    return mapped(lambda s: write(read(s), options))(c)


def expand_keys(c: Column, keys: list[str] | None = None, options: Options = DEFAULT) -> Column:
    """The inverse of ``compact_keys``; ``keys`` serve where a text has no header."""
    return mapped(lambda s: values.loose(values.parse(s, keys=keys), options))(c)


def mode_of(c: Column) -> Column:
    """Which form a text has, by its first characters."""
    t = F.ltrim(c)
    return (
        F.when(t.startswith("@patch"), "patch").when(t.startswith("@tab"), "tabular").when(t.startswith("@frame"), "frame").when(t.startswith("@schema"), "schema")
        .when(t.rlike(r"\A[A-Za-z_]\w*@[({]"), "packed").when(t.rlike(r"\A[A-Za-z_]\w*\{"), "struct").when(t.rlike(r"\A[A-Za-z_]\w*\("), "sum").when(t.startswith("{"), "map").when(t.startswith("["), "list").otherwise("scalar")
    )


def token_estimate(c: Column) -> Column:
    """A rough token count: runs of letters by four, runs of digits by three, and other signs one each."""
    pieces = F.regexp_count(c, F.lit(r"[A-Za-z]{1,4}|[0-9]{1,3}|[^\sA-Za-z0-9]"))
    return pieces.cast("long")


def fnv_text(s: str) -> str:
    """FNV-1a of a text's bytes, 16 hex digits."""
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv_hash(c: Column) -> Column:
    """``fnv_text`` of a column. Kept for old data; SHA-256 identifies."""
    return mapped(fnv_text)(c)


def schema_directive(c: Column) -> Column:
    """A directive line ``@schema#id @keys=[...]``, ``@schema#id`` or ``@schema.clear`` as a struct of ``id``, ``keys`` and ``clear``; null for other lines."""

    def one(s: str) -> dict | None:
        try:
            return values.parse_schema_directive(s)
        except ValueError:
            return None

    return _struct(one, "id string, keys array<string>, clear boolean")(c)


def register(spark: SparkSession) -> list[str]:
    """All functions for SQL."""
    from .sql import register as all_of_them

    return all_of_them(spark)
