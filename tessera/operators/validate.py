"""Validation of typed rows against a schema: all issues as one array column, built at plan time."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import FieldDef, Schema, TypeSpec

ISSUE = "array<struct<level:string,path:string,code:string,message:string>>"


def issue(when: Column, level: str, path: Column | str, code: str, message: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(level).alias("level"), lit(path).alias("path"), F.lit(code).alias("code"), lit(message).alias("message")))


def _size(c: Column, t: T.DataType) -> Column:
    """Bytes of a string or binary, elements of an array."""
    return F.size(c) if isinstance(t, (T.ArrayType, T.MapType)) else F.octet_length(c)


def constraint_issues(f: FieldDef, c: Column, t: T.DataType, path: str) -> list[Column]:
    out = []
    for k in f.constraints:
        v = k.value
        bad: Column
        if k.kind in ("min", "max"):
            bad = c < v if k.kind == "min" else c > v
        elif k.kind == "range":
            bad = (c < v[0]) | (c > v[1])
        elif k.kind in ("minlen", "maxlen", "len", "nonempty"):
            op, n = {"minlen": (operator.lt, v), "maxlen": (operator.gt, v), "len": (operator.ne, v), "nonempty": (operator.eq, 0)}[k.kind]
            bad = op(_size(c, t), n)
        elif k.kind == "regex":
            bad = ~c.rlike(v)
        elif k.kind == "enum":
            bad = ~c.isin(*v)
        elif k.kind == "unique":
            bad = F.size(F.array_distinct(c)) < F.size(c)
        else:
            continue
        out.append(issue(c.isNotNull() & bad, "error", path, f"constraint_{k.kind}", f"{path} breaks {k}"))
    return out


def _fits(spec: TypeSpec, t: T.DataType) -> tuple[bool, bool]:
    """Whether a Spark type fits a schema type, and whether only with a check for whole numbers."""
    fits: dict[str, Any] = {
        "bool": T.BooleanType, "int": T.IntegralType, "float": (T.FractionalType, T.IntegralType), "str": T.StringType, "bytes": T.BinaryType,
        "time": (T.TimestampType, T.TimestampNTZType, T.DateType), "list": T.ArrayType, "map": (T.MapType, T.StructType), "struct": (T.StructType, T.MapType), "null": T.NullType,
    }
    if spec.kind == "id":
        return isinstance(t, (T.StringType, T.StructType)), False
    if spec.kind == "str" and isinstance(t, T.StructType):
        return [f.name for f in t.fields] == ["prefix", "value"], False
    if spec.kind == "int" and isinstance(t, T.FractionalType):
        return True, True
    return isinstance(t, fits.get(spec.kind, T.DataType)), False


def _value_issues(schema: Schema, spec: TypeSpec, c: Column, t: T.DataType, path: str, strict: bool, depth: int) -> list[Column | Many]:
    if isinstance(t, T.NullType):
        return []
    if spec.kind == "ref":
        kind = schema.types.get(spec.name)
        if kind is None:
            return [issue(c.isNotNull(), "warning", path, "unknown_type", f"unknown type reference: {spec.name}")]
        if kind.kind == "sum":
            if not isinstance(t, T.StructType) or "tag" not in t.names:
                return [issue(c.isNotNull(), "error", path, "type_mismatch", f"expected sum {spec.name}")]
            tags = [tag for tag, _ in kind.variants]
            out = [issue(c.isNotNull() & ~c["tag"].isin(*tags), "error", path, "invalid_variant", F.concat(F.lit("unknown variant "), c["tag"], F.lit(f", expected one of: {', '.join(tags)}")))]
            for tag, inner in kind.variants:
                if f"v_{tag}" in t.names:
                    x = F.when(c["tag"] == tag, c[f"v_{tag}"])
                    out += _value_issues(schema, inner, x, t[f"v_{tag}"].dataType, path, strict, depth + 1)
            return out
        if not isinstance(t, T.StructType):
            return [issue(c.isNotNull(), "error", path, "type_mismatch", f"expected struct {spec.name}")]
        return struct_issues(schema, spec.name, c, t, path, strict, depth + 1)
    ok, whole = _fits(spec, t)
    if not ok:
        return [issue(c.isNotNull(), "error", path, "type_mismatch", f"expected {spec}, got {t.simpleString()}")]
    if whole:
        no = c.isNotNull() & ((c != F.floor(c)) | F.isnan(c))
        return [issue(no, "error", path, "type_mismatch", f"expected int, got {t.simpleString()}"), issue(c.isNotNull() & ~no, "warning", path, "implicit_coercion", "float used as int")]
    if spec.kind == "list" and spec.elem is not None and isinstance(t, T.ArrayType) and spec.elem.kind == "ref" and depth < 8:
        return [Many(_elements(schema, spec.elem, c, t, path, strict, depth))]
    return []


@dataclass(frozen=True)
class Many:
    """An array of issues, beside single ones."""

    column: Column


def gathered(parts: list[Column | Many]) -> Column:
    """All issues of the parts as one array, without nulls."""
    single = [p for p in parts if not isinstance(p, Many)]
    found = F.filter(F.array(*single), lambda e: e.isNotNull()) if single else F.array().cast(ISSUE)
    return reduce(lambda a, b: F.concat(a, F.coalesce(b.column, F.array().cast(ISSUE))), [p for p in parts if isinstance(p, Many)], found)


def _elements(schema: Schema, spec: TypeSpec, c: Column, t: T.ArrayType, path: str, strict: bool, depth: int) -> Column:
    """Issues of all elements of a list of structs, as an array."""

    def one(x: Column, i: Column) -> Column:
        found = gathered(_value_issues(schema, spec, x, t.elementType, "", strict, depth + 1))
        at = F.concat(F.lit(path + "["), i.cast("string"), F.lit("]"))
        return F.transform(found, lambda e: F.struct(e["level"].alias("level"), F.concat(at, F.when(e["path"] != "", F.concat(F.lit("."), e["path"])).otherwise("")).alias("path"), e["code"].alias("code"), e["message"].alias("message")))

    return F.flatten(F.transform(c, one))


def struct_issues(schema: Schema, name: str, c: Column | None, t: T.StructType, path: str = "", strict: bool = False, depth: int = 0) -> list[Column | Many]:
    """Issues of a struct column, or of a row (``c`` None): each an issue, null, or many."""
    kind = schema.types.get(name)
    if kind is None:
        return [issue(F.lit(True), "warning", path, "unknown_type", f"unknown type: {name}")]
    if kind.kind != "struct":
        return [issue(F.lit(True), "error", path, "type_mismatch", f"{name} is not a struct type")]
    join = lambda f: f"{path}.{f}" if path else f
    here = F.lit(True) if c is None else c.isNotNull()
    out, known = [], set()
    for f in kind.fields:
        got = f.name if f.name in t.names else f.wire if f.wire in t.names else None
        known |= {f.name, f.wire}
        at = join(f.name)
        if got is None:
            if not f.optional:
                out.append(issue(here, "error", at, "required_field", f"required field missing: {f.name}"))
            continue
        x = F.col(f"`{got}`") if c is None else c[got]
        if not f.optional:
            out.append(issue(here & x.isNull(), "error", at, "required_field_null", f"required field {f.name} may not be null"))
        out += _value_issues(schema, f.type, x, t[got].dataType, at, strict, depth)
        if _fits(f.type, t[got].dataType)[0]:
            out += constraint_issues(f, x, t[got].dataType, at)
    for extra in t.names:
        if extra not in known and extra != "@unknown":
            open_ = kind.open and not strict
            out.append(issue(here, "warning" if open_ else "error", join(extra), "unknown_field_captured" if open_ else "unknown_field", f"unknown field {'captured' if open_ else ''}: {extra}"))
    return out


def issues(df: DataFrame, schema: Schema, name: str, strict: bool = False) -> Column:
    """All issues of a row as an array; empty: valid, but for warnings."""
    return gathered(struct_issues(schema, name, None, df.schema, strict=strict))


def validate(df: DataFrame, schema: Schema, name: str, strict: bool = False) -> DataFrame:
    """``df`` with ``issues`` and ``valid`` (no error among them)."""
    d = df.withColumn("issues", issues(df, schema, name, strict))
    return d.withColumn("valid", ~F.exists("issues", lambda e: e["level"] == "error"))


def capture_unknown(df: DataFrame, schema: Schema, name: str) -> DataFrame:
    """Columns that an ``@open`` type does not know, as text in the map ``@unknown``."""
    kind = schema.types[name]
    known = {f.name for f in kind.fields} | {f.wire for f in kind.fields if f.wire}
    extra = [c for c in df.columns if c not in known and c != "@unknown"]
    if not kind.open or not extra:
        return df
    pairs = F.map_filter(F.create_map(*(x for c in extra for x in (F.lit(c), F.col(f"`{c}`").cast("string")))), lambda k, v: v.isNotNull())
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in known], pairs.alias("@unknown"))


def apply_defaults(df: DataFrame, schema: Schema, name: str) -> DataFrame:
    """Defaults of optional fields in place of nulls and missing columns (top level)."""
    for f in schema.types[name].fields:
        if f.optional and f.default is not None:
            kind = schema.spark_type(f.type)
            value = F.lit(f.default).cast(kind) if not isinstance(kind, T.StructType) else F.lit(None).cast(kind)
            df = df.withColumn(f.name, F.coalesce(F.col(f"`{f.name}`"), value) if f.name in df.columns else value)
    return df


def to_wire(df: DataFrame, schema: Schema, name: str) -> DataFrame:
    return df.withColumnsRenamed({f.name: f.wire for f in schema.types[name].fields if f.wire and f.name in df.columns})


def from_wire(df: DataFrame, schema: Schema, name: str) -> DataFrame:
    return df.withColumnsRenamed({f.wire: f.name for f in schema.types[name].fields if f.wire and f.wire in df.columns and f.name not in df.columns})


def schema_issues(spark, schema: Schema) -> DataFrame:
    """The schema's own faults as rows."""
    return spark.createDataFrame([(i.type_name, i.field_name, i.code, i.message) for i in schema.check()], "type_name string, field_name string, code string, message string")
