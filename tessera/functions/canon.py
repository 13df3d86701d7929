"""Canonical text of typed columns, as one Catalyst expression built from the column's type.

Keys are sorted while the plan is made, separators are literals, and nothing leaves the JVM: the whole text is one
projection inside code generation.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values
from ..plans.schema import FieldDef, Schema, TypeDef
from ..values import DEFAULT, NO_TABULAR, Options

#: Multiples of the least double whose text is listed.
LEAST = 24
_CONTROL = [c for c in range(32) if c not in (9, 10, 13)]


def null_text(options: Options = DEFAULT) -> Column:
    return F.lit(options.null)


def bool_text(c: Column) -> Column:
    return F.when(c, "t").otherwise("f")


def int_text(c: Column) -> Column:
    return c.cast("string")


def shortest_digits(c: Column) -> Column:
    """A double's shortest digits that read back, as the JVM writes numbers (``1.0E23``): Schubfach, from the JSON library that Spark ships.

    Called as a static method in generated code where the session runs in this process, else by ``reflect``.
    """
    owner, method = "com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal", "toString"
    session = SparkSession.getActiveSession()
    jvm = getattr(session, "_jvm", None)
    if jvm is None:
        return F.when(c.isNotNull(), F.reflect(F.lit(owner), F.lit(method), c))
    made = jvm.org.apache.spark.sql.classic.ExpressionUtils
    invoke = jvm.org.apache.spark.sql.catalyst.expressions.objects.StaticInvoke
    named = lambda n: jvm.org.apache.spark.util.Utils.classForName(n, True, True)
    seq = lambda *x: jvm.PythonUtils.toSeq(list(x))
    none, text = getattr(getattr(jvm.scala, "None$"), "MODULE$"), getattr(getattr(jvm.org.apache.spark.sql.types, "StringType$"), "MODULE$")
    java = invoke(named(owner), jvm.org.apache.spark.sql.types.ObjectType(named("java.lang.String")), method, seq(made.expression(c._jc)), seq(), True, True, True, none)
    return Column(made.column(invoke(named("org.apache.spark.unsafe.types.UTF8String"), text, "fromString", seq(java), seq(), True, True, True, none)))


def float_text(c: Column, exact: bool = True, signed_zero: bool = False) -> Column:
    """Shortest digits that read back; an exponent from 1e6 and below 1e-4. NaN and infinities are their own words.

    Digits are exact, without leaving the JVM. ``exact=False`` takes the JVM's own digits, which have one too many for a few doubles of 16 digits and more.
    Both zeros are ``0.0``, which is the canonical form; ``signed_zero`` keeps ``-0.0``, as SQL writes it.
    """
    c = c.cast("double")
    size = F.abs(c)
    digits = shortest_digits(c) if exact else c.cast("string")
    re = lambda x, pattern, to: F.regexp_replace(x, pattern, to)
    e = re(re(digits, r"\A(-?\d)(\d{6})\.(\d+)\z", "$1.$2$3E6"), r"\.?0+E", "E")  # 1e6 to 1e7 is written plain
    e = re(re(re(e, r"E(-?)(\d)\z", "E$10$2"), r"E(\d)", "e+$1"), "E", "e")
    small = re(re(digits, r"\A(-?)(\d)\.(\d+)E-4\z", "$10.000$2$3"), r"0+\z", "")
    if exact:  # the JVM wants two digits, which the few least numbers do not need
        least = F.array(*(F.lit(values.float_text(k * 5e-324)) for k in range(1, LEAST)))
        e = F.when(size < LEAST * 5e-324, F.concat(F.when(c < 0, "-").otherwise(""), F.element_at(least, F.round(size / 5e-324).cast("int")))).otherwise(e)
    return (
        F.when((size >= 1e-3) & (size < 1e6), digits).when(c == 0, digits if signed_zero else "0.0").when(F.isnan(c), "NaN").when(size == F.lit(float("inf")), F.when(c > 0, "Inf").otherwise("-Inf"))
        .when((size >= 1e-4) & (size < 1e-3), small).when(c.isNotNull(), e)
    )


def exact_float(c: Column) -> Column:
    """``float_text`` by the untyped road, in Arrow batches."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(values.float_text, na_action="ignore")

    return text(c)


def is_bare(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z") & ~c.isin(*sorted(values.RESERVED))


def quote_text(c: Column, upper: bool = True) -> Column:
    """``c`` in quotes with its escapes. Hex digits of control characters are ``upper`` or lower case."""
    if upper:
        # JSON's escapes are these, but for \b and \f; a backslash that stands before them is itself one of a pair
        json = F.to_json(F.struct(c.alias("v")))
        text = F.substr(json, F.lit(6), F.length(json) - 6)
        odd = lambda x, k: F.regexp_replace(x, rf"(?<!\\)((?:\\\\)*)\\{k}", rf"$1\\u00{'08' if k == 'b' else '0C'}")
        return F.when(c.rlike(r"[\x00-\x1f\"\\]"), F.when(c.rlike(r"[\x08\x0c]"), odd(odd(text, "b"), "f")).otherwise(text)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    simple = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")], c)
    rare = reduce(lambda x, k: F.replace(x, F.lit(chr(k)), F.lit(f"\\u{k:04x}")), _CONTROL, simple)
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f\"\\]"), F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).otherwise(simple)).otherwise(c), F.lit('"'))


def string_text(c: Column, upper: bool = True) -> Column:
    return F.when(is_bare(c), c).otherwise(quote_text(c, upper))


def is_ref_safe(prefix: Column, value: Column) -> Column:
    return F.concat(prefix, value).rlike(r"\A[A-Za-z0-9_:.\-]+\z") & ~F.contains(value, F.lit(":"))


def ref_text(prefix: Column, value: Column) -> Column:
    prefix = F.coalesce(prefix, F.lit(""))
    whole = F.when(prefix == "", value).otherwise(F.concat(prefix, F.lit(":"), value))
    return F.concat(F.lit("^"), F.when(is_ref_safe(prefix, value), whole).otherwise(quote_text(whole)))


def ref_parse(text: Column) -> Column:
    """``^prefix:value``, split at the first colon."""
    whole = F.regexp_replace(text, r"\A\^", "")
    colon = F.instr(whole, ":")
    return F.struct(
        F.when(colon > 0, F.substring_index(whole, ":", 1)).otherwise("").alias("prefix"),
        F.when(colon > 0, F.substr(whole, colon + 1)).otherwise(whole).alias("value"),
    )


def bytes_text(c: Column) -> Column:
    return F.concat(F.lit('b64"'), F.translate(F.base64(c), "\r\n", ""), F.lit('"'))


def time_text(c: Column, t: T.DataType = T.TimestampType()) -> Column:
    """UTC; a cast to string already cuts the fraction's trailing zeros (Spark keeps microseconds)."""
    if isinstance(t, T.DateType):
        return F.concat(c.cast("string"), F.lit("T00:00:00Z"))
    session = SparkSession.getActiveSession()
    shifted = isinstance(t, T.TimestampType) and (session is None or session.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"))
    utc = F.to_utc_timestamp(c, F.current_timezone()) if shifted else c
    return F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def scalar_text(c: Column, t: T.DataType, upper: bool = True, exact: bool = True, signed_zero: bool = False) -> Column:
    """A scalar that is not null."""
    if isinstance(t, T.BooleanType):
        return bool_text(c)
    if isinstance(t, T.IntegralType):
        return int_text(c)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return float_text(c, exact, signed_zero)
    if isinstance(t, T.BinaryType):
        return bytes_text(c)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return time_text(c, t)
    if isinstance(t, T.DecimalType):
        return c.cast("string")
    return string_text(c.cast("string"), upper)


def _kind(field: T.StructField) -> str:
    return (field.metadata or {}).get("kind", "")


def _sorted_fields(t: T.StructType) -> list[T.StructField]:
    return sorted(t.fields, key=lambda f: values.string_text(f.name).encode())


def loose_text(c: Column, t: T.DataType, options: Options = DEFAULT, kind: str = "", absent_when_null: bool = False, exact: bool = True, signed_zero: bool = False) -> Column:
    """Canonical loose text of a column of type ``t``. A null struct field is null, or with ``absent_when_null`` not there.

    NaN and infinities, which have no loose form, raise.
    """
    index = {k: i for i, k in enumerate(options.keys)}
    key = lambda k: f"#{index[k]}" if k in index else values.string_text(k)
    down = lambda x, u, k="": loose_text(x, u, options, k, absent_when_null, exact, signed_zero)
    if isinstance(t, T.NullType):
        return null_text(options)
    if isinstance(t, T.StructType) and kind == "id":
        body = ref_text(c["prefix"], c["value"])
    elif isinstance(t, T.StructType) and t.fields and t.fields[0].name == "tag" and all(_kind(f) == "sum" for f in t.fields[1:]):
        body = F.concat(F.lit("{"), string_text(c["tag"]), F.lit("="), _variant(c, t, down, options), F.lit("}"))
    elif isinstance(t, T.StructType):
        parts = []
        for f in _sorted_fields(t):
            text = F.concat(F.lit(key(f.name) + "="), down(c[f.name], f.dataType, _kind(f)))
            parts.append(F.when(c[f.name].isNotNull(), text) if absent_when_null else text)
        body = F.concat(F.lit("{"), F.concat_ws(" ", *parts), F.lit("}"))
    elif isinstance(t, T.ArrayType):
        listed = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: down(x, t.elementType)), " "), F.lit("]"))
        body = listed
        e = t.elementType
        if options.auto_tabular and isinstance(e, T.StructType) and 0 < len(e.fields) <= options.max_cols and not absent_when_null:
            body = F.when((F.size(c) >= options.min_rows) & ~F.exists(c, lambda x: x.isNull()), table_text(c, e, options, exact, signed_zero)).otherwise(listed)
    elif isinstance(t, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(string_text(e["key"].cast("string")).alias("k"), down(e["value"], t.valueType).alias("v")))
        named = (lambda k: F.coalesce(F.element_at(F.create_map(*(x for kk, i in index.items() for x in (F.lit(values.string_text(kk)), F.lit(f"#{i}")))), k), k)) if index else lambda k: k
        body = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(named(e["k"]), F.lit("="), e["v"])), " "), F.lit("}"))
    else:
        body = scalar_text(c, t, exact=exact, signed_zero=signed_zero)
        if isinstance(t, (T.DoubleType, T.FloatType)):
            body = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("NaN and infinities have no loose form")).cast("string")).otherwise(body)
    return F.when(c.isNull(), null_text(options)).otherwise(body)


def _variant(c: Column, t: T.StructType, down, options: Options) -> Column:
    whens = null_text(options)
    for f in t.fields[1:]:
        whens = F.when(c["tag"] == f.name.removeprefix("v_"), down(c[f.name], f.dataType)).otherwise(whens)
    return whens


def table_row(x, e: T.StructType, options: Options = DEFAULT, exact: bool = True, signed_zero: bool = False) -> Column:
    """A struct's line in a table; ``x`` gives a column for a name."""
    cells = [F.replace(loose_text(x[f.name], f.dataType, options, _kind(f), exact=exact, signed_zero=signed_zero), F.lit("|"), F.lit("\\|")) for f in _sorted_fields(e)]
    return F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|\n"))


def table_lines(n: Column, lines: Column, e: T.StructType, options: Options = DEFAULT) -> Column:
    """A table of ``n`` rows whose lines are put together."""
    index = {k: i for i, k in enumerate(options.keys)}
    names = " ".join(f"#{index[f.name]}" if f.name in index else values.string_text(f.name) for f in _sorted_fields(e))
    return F.concat(F.lit("@tab _ rows="), n.cast("string"), F.lit(f" cols={len(e.fields)} [{names}]\n"), lines, F.lit("@end"))


def table_text(c: Column, e: T.StructType, options: Options = DEFAULT, exact: bool = True, signed_zero: bool = False) -> Column:
    """An array of structs as a table: header with numbers of rows and columns, a piped row each, ``@end``."""
    return table_lines(F.size(c), F.array_join(F.transform(c, lambda x: table_row(x, e, options, exact, signed_zero)), ""), e, options)


def typed_text(c: Column, t: T.DataType, kind: str = "", name: str = "", wire: bool = False, exact: bool = True, signed_zero: bool = False) -> Column:
    """Typed text: structs carry a name and sort by raw key, maps are ``{k:v}``, null is ``∅``."""
    down = lambda x, u, k="", n="": typed_text(x, u, k, n, wire, exact, signed_zero)
    if isinstance(t, T.StructType) and kind == "id":
        body = ref_text(c["prefix"], c["value"])
    elif isinstance(t, T.StructType):
        parts = []
        for f in sorted(t.fields, key=lambda f: f.name.encode()):
            meta = f.metadata or {}
            parts.append(F.concat(F.lit((wire and meta.get("wire") or f.name) + "="), down(c[f.name], f.dataType, _kind(f), meta.get("type_name", ""))))
        body = F.concat(F.lit((name or "") + "{"), F.concat_ws(" ", *parts), F.lit("}"))
    elif isinstance(t, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: down(x, t.elementType, "", name)), " "), F.lit("]"))
    elif isinstance(t, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), down(e["value"], t.valueType).alias("v"))))
        body = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(string_text(e["k"], False), F.lit(":"), e["v"])), " "), F.lit("}"))
    else:
        body = scalar_text(c, t, False, exact, signed_zero)
    return F.when(c.isNull(), F.lit("∅")).otherwise(body)


def mask_text(present: list[Column]) -> Column:
    """Presence bits as ``0b…``: the first field's is the lowest; leading zeros are cut."""
    if not present:
        return F.lit("0b0")
    bits = F.concat(*(F.when(p, "1").otherwise("0") for p in reversed(present)))
    return F.concat(F.lit("0b"), F.coalesce(F.nullif(F.regexp_replace(bits, "^0+", ""), F.lit("")), F.lit("0")))


def mask_bits(text: Column, n: int) -> Column:
    """Array of ``n`` presence flags of a mask."""
    padded = F.reverse(F.lpad(F.regexp_replace(text, "^0b", ""), n, "0"))
    return F.transform(F.split(padded, ""), lambda x: x == "1") if n else F.array().cast("array<boolean>")


def packed_text(c: Column, t: T.StructType, kind: TypeDef, schema: Schema, bitmap: bool = True, exact: bool = True, signed_zero: bool = False) -> Column:
    """``T@(v …)`` in order of field ids or, where an optional field is null, ``T@{bm=0b…}(v …)``. A null required field raises."""
    fields = kind.by_fid()
    optional = [f for f in fields if f.optional]

    def value(f: FieldDef) -> Column:
        x = c[f.name]
        text = _packed_value(x, t[f.name].dataType, f.type, schema, bitmap, exact, signed_zero)
        if f.optional:
            return F.coalesce(text, F.lit("∅"))
        return F.when(x.isNull(), F.raise_error(F.lit(f"missing required field: {kind.name}.{f.name}")).cast("string")).otherwise(text)

    dense = F.concat(F.lit(f"{kind.name}@("), F.concat_ws(" ", *(value(f) for f in fields)), F.lit(")"))
    if not optional or not bitmap:
        return F.when(c.isNotNull(), dense)
    present = [F.lit(True) if f.keep_null else c[f.name].isNotNull() for f in optional]
    some = [value(f) for f in fields if not f.optional] + [F.when(p, value(f)) for f, p in zip(optional, present, strict=True)]
    sparse = F.concat(F.lit(f"{kind.name}@{{bm="), mask_text(present), F.lit("}("), F.concat_ws(" ", *some), F.lit(")"))
    return F.when(c.isNotNull(), F.when(reduce(lambda a, b: a & b, present), dense).otherwise(sparse))


def _packed_value(x: Column, t: T.DataType, spec, schema: Schema, bitmap: bool, exact: bool, signed_zero: bool) -> Column:
    """Null stays null."""
    if spec.kind == "id" and isinstance(t, T.StructType):
        return F.when(x.isNotNull(), ref_text(x["prefix"], x["value"]))
    if spec.kind == "ref" and isinstance(t, T.StructType) and spec.name in schema.types:
        inner = schema.types[spec.name]
        return packed_text(x, t, inner, schema, bitmap, exact, signed_zero) if inner.pack else F.when(x.isNotNull(), typed_text(x, t, name=inner.name, exact=exact, signed_zero=signed_zero))
    if spec.kind == "list" and isinstance(t, T.ArrayType):
        items = F.transform(x, lambda e: F.coalesce(_packed_value(e, t.elementType, spec.elem, schema, bitmap, exact, signed_zero), F.lit("∅")))
        return F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(items, " "), F.lit("]")))
    return F.when(x.isNotNull(), typed_text(x, t, exact=exact, signed_zero=signed_zero))


def tabular_text(c: Column, e: T.StructType, kind: TypeDef, schema: Schema, wire: bool = True, inline: bool = False, exact: bool = True, signed_zero: bool = False) -> Column:
    """An array of structs as a typed table ``@tab T [columns]`` with rows on lines, or between bars on one line."""
    fields = kind.by_fid()
    names = " ".join(wire and f.wire or f.name for f in fields)
    row = lambda x: F.concat_ws(" ", *(F.coalesce(_packed_value(x[f.name], e[f.name].dataType, f.type, schema, True, exact, signed_zero), F.lit("∅")) for f in fields))
    if inline:
        return F.concat(F.lit(f"@tab {kind.name} [{names}] "), F.array_join(F.transform(c, row), " | "), F.lit(" @end"))
    return F.concat(F.lit(f"@tab {kind.name} [{names}]\n"), F.array_join(F.transform(c, lambda x: F.concat(row(x), F.lit("\n"))), ""), F.lit("@end"))


# --- rows of a DataFrame


def row_struct(df: DataFrame, cols: list[str] | None = None) -> tuple[Column, T.StructType]:
    cols = cols or df.columns
    return F.struct(*(F.col(f"`{c}`") for c in cols)), T.StructType([df.schema[c] for c in cols])


def canon_row(df: DataFrame, cols: list[str] | None = None, options: Options = DEFAULT, **how) -> Column:
    """A row's columns as one canonical map.

    A wide row's text in one method of whole-stage code is longer than HotSpot compiles (8000 bytes). With ``spark.sql.codegen.hugeMethodLimit``
    at 8000 Spark splits the projection into small methods, about twice as fast; that is the session's to set.
    """
    cols = cols or df.columns
    t = T.StructType([df.schema[c] for c in cols])
    index = {k: i for i, k in enumerate(options.keys)}
    absent = how.get("absent_when_null", False)
    parts = []
    for f in _sorted_fields(t):
        c = F.col(f"`{f.name}`")
        text = F.concat(F.lit((f"#{index[f.name]}" if f.name in index else values.string_text(f.name)) + "="), loose_text(c, f.dataType, options, _kind(f), **how))
        parts.append(F.when(c.isNotNull(), text) if absent else text)
    return F.concat(F.lit("{"), F.concat_ws(" ", *parts), F.lit("}"))


def fingerprint_row(df: DataFrame, cols: list[str] | None = None, **how) -> Column:
    """SHA-256 of the row's no-table form: equal for equal rows, whatever the columns' order (with ``signed_zero``, zeros of different sign are not equal)."""
    return F.sha2(canon_row(df, cols, NO_TABULAR, **how), 256)


def patch_base_row(df: DataFrame, cols: list[str] | None = None, **how) -> Column:
    return F.substring(F.sha2(canon_row(df, cols, DEFAULT, **how), 256), 1, 16)


def state_hash_row(df: DataFrame, cols: list[str] | None = None, **how) -> Column:
    return F.unhex(F.sha2(canon_row(df, cols, DEFAULT, **how), 256))


def equal_rows(a: tuple[Column, T.DataType], b: tuple[Column, T.DataType]) -> Column:
    return loose_text(*a, NO_TABULAR) == loose_text(*b, NO_TABULAR)


def has_non_finite(c: Column, t: T.DataType) -> Column:
    """Whether NaN or an infinity lies anywhere in the value."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: has_non_finite(x, t.elementType)), F.lit(False))
    if isinstance(t, T.MapType):
        return F.coalesce(F.exists(F.map_values(c), lambda x: has_non_finite(x, t.valueType)), F.lit(False))
    if isinstance(t, T.StructType):
        return reduce(lambda a, b: a | b, [has_non_finite(c[f.name], f.dataType) for f in t.fields], F.lit(False))
    return F.lit(False)


def select_mode(t: T.DataType, kind: TypeDef | None, threshold: int = 3, size: Column | None = None) -> Column:
    """How a column of a schema's type is best written: ``tabular``, ``packed`` or ``struct``. All but a list's size is known at plan time."""
    if isinstance(t, T.ArrayType) and kind is not None and kind.tab and size is not None:
        return F.when(size >= threshold, "tabular").otherwise("struct")
    return F.lit("packed" if isinstance(t, T.StructType) and kind is not None and kind.pack else "struct")


def auto_text(c: Column, t: T.DataType, kind: TypeDef, schema: Schema, threshold: int = 3) -> Column:
    """A column of a schema's type in the mode that ``select_mode`` gives."""
    if isinstance(t, T.ArrayType):
        plain = typed_text(c, t, name=kind.name)
        return F.when(F.size(c) >= threshold, tabular_text(c, t.elementType, kind, schema)).otherwise(plain) if kind.tab else plain
    return packed_text(c, t, kind, schema) if kind.pack else typed_text(c, t, name=kind.name)
