"""The engine's functions for SQL: ``register(spark)`` makes scalar, grouped and table functions known to a session.

Functions that Spark's own expressions can say are SQL functions (they are inlined and stay in code generation); the others read text
of unknown shape in Arrow batches. A null argument gives null, and so does a text that cannot be read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values
from ..operators import events, evolve, frames, patch, tools
from .text import fnv_text, mapped


def _all(fn: Callable[..., Any], kind: str) -> Callable[..., Any]:
    """``fn`` on the values of several columns."""

    def one(*x: Any) -> Any:
        if any(v is None or isinstance(v, float) and v != v for v in x):
            return None
        try:
            return fn(*x)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(a, b, strict=True)], dtype=object)

    return two


def _tool(call: str) -> str:
    """Tool and sorted fault codes of one call, by the safe tools' rules: ``search:`` or ``search:CONSTRAINT_MIN:max_results``."""
    t = tools.TokenValidator(tools.rules())
    v = t.push(call)
    return f"{v.tool or ''}:{','.join(sorted(v.errors or ([] if v.complete else ['INCOMPLETE'])))}"


def _diff(a: str, b: str) -> str:
    return patch.emit(patch.diff(values.parse(a), values.parse(b)))


def _apply(doc: str, text: str) -> str:
    return values.loose(patch.apply(values.parse(doc), patch.parse(text)))


def _verify(doc: str, text: str) -> bool:
    base = patch.parse(text).base
    return not base or values.patch_base(values.parse(doc)) == base


#: Functions of one text: name, function, type.
_ONE: list[tuple[str, Callable[[Any], Any], str]] = [
    ("canon_loose", lambda s: values.loose(values.parse(s)), "string"),
    ("canon_text", lambda s: values.loose(values.parse(s)), "string"),
    ("canon_no_tabular", lambda s: values.loose(values.parse(s), values.NO_TABULAR), "string"),
    ("canon_typed", lambda s: values.typed(values.parse(s, True)), "string"),
    ("canon_json", lambda s: values.loose(values.from_json(s)), "string"),
    ("from_json_text", lambda s: values.loose(values.from_json(s)), "string"),
    ("to_json_text", lambda s: values.to_json(values.parse(s)), "string"),
    ("parse_loose", lambda s: values.to_json(values.parse(s)), "string"),
    ("parse_typed", lambda s: values.to_json(values.parse_tolerant(s)[0]), "string"),
    ("fingerprint", lambda s: values.fingerprint(values.parse(s)), "string"),
    ("fingerprint_text", lambda s: values.fingerprint(values.parse(s)), "string"),
    ("fingerprint_json", lambda s: values.fingerprint(values.from_json(s)), "string"),
    ("patch_base", lambda s: values.patch_base(values.parse(s)), "string"),
    ("patch_base_json", lambda s: values.patch_base(values.from_json(s)), "string"),
    ("key_dict", lambda s: values.key_dictionary(values.from_json(s)), "array<string>"),
    ("schema_context_id", lambda ks: values.schema_context_id(list(ks)), "string"),
    ("quote_text", values.quote, "string"),
    ("canon_scalar", values.string_text, "string"),
    ("float_literal", values.float_text, "string"),
    ("bytes_literal", lambda b: values.bytes_text(bytes(b)), "string"),
    ("fnv_hash", fnv_text, "string"),
    ("tab_encode", lambda s: values.loose(values.from_json(s), values.DEFAULT.replace(min_rows=1)), "string"),
    ("patch_emit", lambda s: patch.emit(patch.parse(s)), "string"),
    ("tool_validate", _tool, "string"),
]
#: Functions of two arguments.
_TWO: list[tuple[str, Callable[[Any, Any], Any], str]] = [
    ("equal_loose", lambda a, b: values.equal(values.parse(a), values.parse(b)), "boolean"),
    ("json_equal", values.json_equal, "boolean"),
    ("ref_text", lambda p, v: values.ref_text(values.Ref(p, v)), "string"),
    ("compact_keys", lambda s, ks: values.loose_with_schema(values.from_json(s), values.LLM.replace(keys=tuple(ks))), "string"),
    ("expand_keys", lambda s, ks: values.loose(values.parse(s, keys=list(ks))), "string"),
    ("patch_apply", _apply, "string"),
    ("patch_diff", _diff, "string"),
    ("patch_verify", _verify, "boolean"),
    ("version_cmp", evolve.version_compare, "int"),
]
#: Functions in SQL: name with arguments, type, body.
_SQL: list[tuple[str, str, str]] = [
    ("is_bare_safe(s STRING)", "BOOLEAN", r"s RLIKE '\\A[A-Za-z_][A-Za-z0-9_]*\\z' AND s NOT IN (" + ", ".join(f"'{w}'" for w in sorted(values.RESERVED)) + ")"),
    ("is_ref_safe(p STRING, v STRING)", "BOOLEAN", r"concat(p, v) RLIKE '\\A[A-Za-z0-9_:.\\-]+\\z' AND NOT contains(v, ':')"),
    ("cid(c BINARY)", "STRING", "concat('sha256:', sha2(c, 256))"),
    ("blob_text(c BINARY, mime STRING)", "STRING", "concat('@blob cid=sha256:', sha2(c, 256), ' mime=', mime, ' bytes=', octet_length(c))"),
    ("frame_crc(c BINARY)", "STRING", "lpad(lower(hex(crc32(c))), 8, '0')"),
    ("frame_header(sid BIGINT, seq BIGINT, kind STRING, c BINARY)", "STRING", "concat('@frame{v=1 sid=', sid, ' seq=', seq, ' kind=', kind, ' len=', octet_length(c), if(octet_length(c) > 0, concat(' crc=', lpad(lower(hex(crc32(c))), 8, '0')), ''), '}')"),
    ("frame_field(h STRING, k STRING)", "STRING", r"nullif(regexp_extract(h, concat('[{\\s]', k, '=([^\\s}]+)'), 1), '')"),
    ("tab_rows_said(t STRING)", "INT", r"try_cast(regexp_extract(substring_index(t, '\n', 1), '\\srows=(\\d+)', 1) AS INT)"),
    ("state_hash(canon STRING)", "BINARY", "unhex(sha2(canon, 256))"),
    ("token_estimate(s STRING)", "BIGINT", r"regexp_count(s, '[A-Za-z]{1,4}|[0-9]{1,3}|[^\\sA-Za-z0-9]')"),
    ("version_of(t STRING)", "STRING", r"nullif(regexp_extract(t, '\\A\\s*@version\\s+(\\S+)', 1), '')"),
    ("mask_text(bits ARRAY<BOOLEAN>)", "STRING", "concat('0b', coalesce(nullif(regexp_replace(array_join(transform(reverse(bits), b -> if(b, '1', '0')), ''), '^0+', ''), ''), '0'))"),
    ("mask_bits(m STRING, n INT)", "ARRAY<BOOLEAN>", "transform(split(reverse(lpad(regexp_replace(m, '^0b', ''), n, '0')), ''), x -> x = '1')"),
]


# --- table functions


@F.udtf(returnType="pos int, event string, path string, key string, value string, type_name string")
class ParseEvents:
    """``parse_events(text)``: the parse events of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from events.events_of([text])


@F.udtf(returnType="pos int, json string")
class TabRows:
    """``tab_rows(text)``: the rows of a table, as JSON."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            for k, row in enumerate(values.parse(text)):
                yield k, values.to_json(row)


@F.udtf(returnType="sid decimal(20,0), seq decimal(20,0), kind string, len bigint, payload binary, base string, final boolean, error string")
class Frames:
    """``frames(bytes)``: the frames of a byte string."""

    def eval(self, raw: bytes) -> Iterator[tuple]:
        from decimal import Decimal

        if raw is not None:
            raw = bytes(raw)
            found, end = frames.split_frames(raw)
            if end < len(raw):
                found.append(frames._faulty(raw[end:], "FRAME_INVALID: cut off", False))
            for sid, seq, kind, _, size, body, _, base, _, final, error in found:
                yield *(None if x is None else Decimal(x) for x in (sid, seq)), kind, size, body, base, final, error


@F.udtf(returnType="pos int, op string, path string, value string, idx int")
class PatchOps:
    """``patch_ops(text)``: the operations of a patch."""

    def eval(self, text: str) -> Iterator[tuple]:
        for n, o in enumerate(patch.parse(text).ops if text else []):
            yield n, o.op, patch.path_text(o.path), None if o.op == patch.DELETE else values.typed(o.value), o.index


# --- grouped functions: a group's values meet in one task, so groups must be of bounded size


@F.pandas_udf(T.StringType())
def key_dict_agg(texts: pd.Series) -> str:
    """The sorted keys of a group's JSON objects, as a JSON array."""
    found: set[str] = set()
    for t in texts:
        if t is not None:
            found.update(values.key_dictionary(values.from_json(t)))
    return json.dumps(sorted(found), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def tab_agg(texts: pd.Series) -> str:
    """A group's JSON objects as one table, rows in order of their canonical text."""
    rows = sorted((values.from_json(t) for t in texts if t is not None), key=lambda v: values.loose(v).encode())
    return values.loose(rows, values.DEFAULT.replace(min_rows=1))


@F.pandas_udf(T.StringType())
def patch_fold(doc: pd.Series, seq: pd.Series, text: pd.Series) -> str:
    """A document (the same in all rows of the group) with the group's patches applied in order of ``seq``; null where one fails."""
    try:
        v = values.parse(doc.iloc[0])
        for _, t in sorted(zip(seq, text, strict=True), key=lambda x: (x[0], x[1] or "")):
            v = patch.apply(v, patch.parse(t)) if t else v
        return values.loose(v)
    except (ValueError, TypeError):
        return None


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names."""
    for name, fn, kind in _ONE:
        spark.udf.register(name, mapped(fn, kind))
    for name, fn, kind in _TWO:
        spark.udf.register(name, _all(fn, kind))
    for head, kind, body in _SQL:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for name, fn in (("key_dict_agg", key_dict_agg), ("tab_agg", tab_agg), ("patch_fold", patch_fold)):
        spark.udf.register(name, fn)
    for name, cls in (("parse_events", ParseEvents), ("tab_rows", TabRows), ("frames", Frames), ("patch_ops", PatchOps)):
        spark.udtf.register(name, cls)
    return [n for n, *_ in _ONE + _TWO] + [h.split("(")[0] for h, *_ in _SQL] + ["key_dict_agg", "tab_agg", "patch_fold", "parse_events", "tab_rows", "frames", "patch_ops"]
