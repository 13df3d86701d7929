"""Versions of flat records: migrations are projections planned on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import to_json_text
from ..values import ValueError_

SPARK_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "list": "array<string>", "decimal": "decimal(38,10)"}


@dataclass
class VersionField:
    name: str
    type: str = "str"
    required: bool = False
    default: Any = None
    added_in: str = ""
    deprecated_in: str = ""
    renamed_from: str = ""
    pattern: str = ""


def version_key(v: str) -> tuple[int, ...]:
    """Dotted versions compare by number; a part that is none counts as 0."""
    return tuple(int(p) if p.isdigit() else 0 for p in v.split("."))


def version_compare(a: str, b: str) -> int:
    x, y = version_key(a), version_key(b)
    n = max(len(x), len(y))
    x, y = x + (0,) * (n - len(x)), y + (0,) * (n - len(y))
    return (x > y) - (x < y)


@dataclass
class VersionedSchema:
    name: str
    mode: str = "tolerant"  # strict, tolerant or migrate
    versions: dict[str, list[VersionField]] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)

    def add_version(self, version: str, fields: list[VersionField], description: str = "") -> VersionedSchema:
        self.versions[version] = fields
        self.descriptions[version] = description
        return self

    def ordered(self) -> list[str]:
        return sorted(self.versions, key=version_key)

    def latest(self) -> str:
        return self.ordered()[-1] if self.versions else "1.0"

    def fields(self, version: str) -> list[VersionField]:
        if version not in self.versions:
            raise ValueError_(f"unknown version: {version}")
        return self.versions[version]

    def path(self, source: str, target: str) -> list[str]:
        """Versions to step through; going down is refused."""
        order = self.ordered()
        self.fields(source), self.fields(target)
        a, b = order.index(source), order.index(target)
        if b < a:
            raise ValueError_(f"no way down from {source} to {target}")
        return order[a + 1 : b + 1]

    def available(self, name: str, version: str) -> bool:
        f = next((f for f in self.fields(version) if f.name == name), None)
        return f is not None and (not f.added_in or version_compare(version, f.added_in) >= 0)

    def deprecated(self, name: str, version: str) -> bool:
        f = next((f for f in self.fields(version) if f.name == name), None)
        return f is not None and bool(f.deprecated_in) and version_compare(version, f.deprecated_in) >= 0

    def changelog(self, spark: SparkSession) -> DataFrame:
        rows = []
        for k, v in enumerate(self.ordered()):
            f = self.versions[v]
            rows.append((k, v, self.descriptions.get(v, ""), sorted(x.name for x in f if x.added_in == v), sorted(x.name for x in f if x.deprecated_in == v), sorted(f"{x.renamed_from}->{x.name}" for x in f if x.renamed_from)))
        return spark.createDataFrame(rows, "pos int, version string, description string, added array<string>, deprecated array<string>, renamed array<string>")


def availability(spark: SparkSession, s: VersionedSchema) -> DataFrame:
    """Whether each field is there, and deprecated, in each version: ``pos, version, field, available, deprecated``."""
    names = sorted({f.name for v in s.versions for f in s.versions[v]})
    rows = [(k, v, n, s.available(n, v), s.deprecated(n, v)) for k, v in enumerate(s.ordered()) for n in names]
    return spark.createDataFrame(rows, "pos int, version string, field string, available boolean, deprecated boolean")


def problem(s: VersionedSchema, version: str, df: DataFrame) -> Column:
    """The first fault of a row under a version, or null."""
    checks = [F.when(F.col(f"`{f.name}`").isNull() if f.name in df.columns else F.lit(True), f"Missing required field: {f.name}") for f in s.fields(version) if f.required]
    for f in s.fields(version):
        if f.name not in df.columns:
            continue
        c = F.col(f"`{f.name}`")
        kind = df.schema[f.name].dataType.simpleString().split("(")[0].split("<")[0]
        fits = {"str": ("string",), "int": ("int", "bigint", "smallint", "tinyint"), "float": ("double", "float", "int", "bigint"), "bool": ("boolean",), "list": ("array",), "decimal": ("decimal",)}[f.type]
        if kind not in fits:
            checks.append(F.when(c.isNotNull(), f"Field {f.name} must be {f.type}"))
        elif f.pattern and f.type == "str":
            checks.append(F.when(~c.rlike(rf"\A(?:{f.pattern})"), f"Field {f.name} does not match pattern"))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def migrate(df: DataFrame, s: VersionedSchema, source: str, target: str | None = None) -> DataFrame:
    """Rows of one version as rows of another: renames, then defaults, then unknown columns go unless mode is ``migrate``.

    One ``select``: no shuffle, no UDF. In ``strict`` mode the faults of rows raise when they are read.
    """
    target = target or s.latest()
    if s.mode == "strict":
        p = problem(s, source, df)
        first = df.columns[0]
        df = df.withColumn(first, F.when(p.isNotNull(), F.raise_error(p).cast(df.schema[first].dataType)).otherwise(F.col(f"`{first}`")))
    cols: dict[str, Column] = {c: F.col(f"`{c}`") for c in df.columns}
    for version in s.path(source, target):
        fields = s.fields(version)
        for f in fields:
            if f.renamed_from and f.renamed_from in cols and f.name not in cols:
                cols[f.name] = cols.pop(f.renamed_from)
        for f in fields:
            if f.name not in cols and (f.default is not None or not f.required):
                cols[f.name] = F.lit(f.default).cast(SPARK_TYPES[f.type])
        if s.mode == "tolerant":
            cols = {c: e for c, e in cols.items() if c in {f.name for f in fields}}
    if s.mode == "tolerant":
        cols = {c: e for c, e in cols.items() if c in {f.name for f in s.fields(target)}}
    return df.select(*(e.alias(c) for c, e in cols.items()))


def migrate_mixed(df: DataFrame, s: VersionedSchema, version_col: str, target: str | None = None) -> DataFrame:
    """Rows of several versions in one table as rows of ``target``, with ``problem``: a migration for each known version, put together.

    Rows of an unknown version, of none, or of one above the target are kept, with what columns they share with the target and ``problem`` naming the fault.
    """
    target = target or s.latest()
    known = [v for v in s.ordered() if version_compare(v, target) <= 0]
    parts = [migrate(df.where(F.col(version_col) == v).select(*(c for c in df.columns if c in {f.name for f in s.fields(v)})), s, v, target).withColumn("problem", F.lit(None).cast("string")) for v in known]
    odd = df.where(F.col(version_col).isNull() | ~F.col(version_col).isin(*known))
    shared = [c for c in parts[0].columns if c in df.columns and c != "problem"]
    parts.append(odd.select(*shared, F.concat(F.lit("no way from version "), F.coalesce(F.col(version_col).cast("string"), F.lit("(none)")), F.lit(f" to {target}")).alias("problem")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def parse_versions(df: DataFrame, s: VersionedSchema, text: str, target: str | None = None) -> DataFrame:
    """``df`` of documents that begin with ``@version X`` (the earliest where none is named) as rows of ``target``, with ``problem``.

    The body is read once as JSON of all versions' fields; ``migrate_mixed`` does the rest. In ``strict`` mode a row's fault is its ``problem``.
    """
    fields: dict[str, VersionField] = {}
    for v in s.ordered():
        for f in s.fields(v):
            fields.setdefault(f.name, f)
    types = T.StructType([T.StructField(f.name, T._parse_datatype_string(SPARK_TYPES[f.type])) for f in fields.values()])
    body = to_json_text(F.regexp_replace(F.col(text), r"\A\s*@version\s+\S+\s*", ""))
    at = F.coalesce(parse_version_header(F.col(text)), F.lit(s.ordered()[0]))
    others = [c for c in df.columns if c != text]
    d = df.select(*others, at.alias("_version"), F.from_json(body, types).alias("_r")).select(*others, "_version", "_r.*")
    key = VersionedSchema(s.name, s.mode if s.mode != "strict" else "tolerant", {v: [*(VersionField(c, required=False) for c in others), *fs] for v, fs in s.versions.items()}, s.descriptions)
    if s.mode != "strict":
        return migrate_mixed(d, key, "_version", target)
    faults = F.coalesce(*(F.when(F.col("_version") == v, problem(s, v, d)) for v in s.ordered()))
    d = d.withColumn("_fault", faults)
    for v in key.versions:
        key.versions[v] = [VersionField("_fault"), *key.versions[v]]
    out = migrate_mixed(d, key, "_version", target)
    return out.withColumn("problem", F.coalesce("problem", "_fault")).drop("_fault")


def version_header(version: str) -> str:
    return f"@version {version}"


def parse_version_header(c: Column) -> Column:
    """The version that ``@version X`` names, or null."""
    got = F.regexp_extract(c, r"\A\s*@version\s+(\S+)", 1)
    return F.when(got != "", got)


def emit_header(df: DataFrame, s: VersionedSchema, version: str | None = None) -> DataFrame:
    """``df`` with ``header`` for rows that fit the version, else null and ``problem``."""
    version = version or s.latest()
    d = df.withColumn("problem", problem(s, version, df))
    return d.withColumn("header", F.when(F.col("problem").isNull(), version_header(version)))
