"""Patches: their text, their effect on values and on tables, and the difference of two tables."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values
from ..functions.canon import loose_text
from ..plans.schema import Schema

SET, APPEND, DELETE, DELTA = "=", "+", "-", "~"
_PLAIN_SEGMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*\Z", re.ASCII)


@dataclass(frozen=True)
class Seg:
    kind: str  # field, key, index or fid
    at: Any


@dataclass
class Op:
    op: str
    path: list[Seg]
    value: Any = None
    index: int = -1


@dataclass
class Patch:
    target: str = ""
    schema_id: str = ""
    base: str = ""
    keys: str = "wire"
    ops: list[Op] = field(default_factory=list)

    # building

    def _add(self, op: str, path: str | list[Seg], value: Any = None, index: int = -1) -> Patch:
        self.ops.append(Op(op, parse_path(path) if isinstance(path, str) else path, value, index))
        return self

    def set(self, path: str | list[Seg], value: Any) -> Patch:
        return self._add(SET, path, value)

    def append(self, path: str | list[Seg], value: Any) -> Patch:
        return self._add(APPEND, path, value)

    def insert_at(self, path: str | list[Seg], index: int, value: Any) -> Patch:
        return self._add(APPEND, path, value, index)

    def delete(self, path: str | list[Seg]) -> Patch:
        return self._add(DELETE, path)

    def delta(self, path: str | list[Seg], by: float) -> Patch:
        return self._add(DELTA, path, float(by))

    def with_base(self, value: Any) -> Patch:
        self.base = values.patch_base(value)
        return self


def parse_path(text: str) -> list[Seg]:
    """``a.b[0]["key"].#3``: fields, list places, map keys and field numbers."""
    out, at = [], 0
    token = re.compile(r'\.?(?:#(\d+)|\[(\d+)\]|\[("(?:[^"\\]|\\.)*")\]|("(?:[^"\\]|\\.)*")|([A-Za-z_][A-Za-z0-9_\-]*))')
    if text == ".":
        return []
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise values.ValueError_(f"a bad path: {text}")
        fid, place, key, quoted, name = m.groups()
        if fid:
            out.append(Seg("fid", int(fid)))
        elif place:
            out.append(Seg("index", int(place)))
        elif key:
            out.append(Seg("key", values.Reader(key).string()))
        else:
            out.append(Seg("field", values.Reader(quoted).string() if quoted else name))
        at = m.end()
    return out


def path_text(path: list[Seg]) -> str:
    out = ""
    for k, s in enumerate(path):
        dot = "." if k else ""
        if s.kind == "index":
            out += f"[{s.at}]"
        elif s.kind == "key":
            out += f"[{values.quote(s.at)}]"
        elif s.kind == "fid":
            out += f"{dot}#{s.at}"
        else:
            out += dot + (s.at if _PLAIN_SEGMENT.match(s.at) else values.quote(s.at))
    return out or "."


def emit(p: Patch, sort: bool | None = None, indent: str = "") -> str:
    """A patch's text. Operations are sorted by path, stably, unless a path occurs twice (its order then counts)."""
    head = "@patch" + (f" @schema#{p.schema_id}" if p.schema_id else "") + f" @keys={p.keys} @target={values.ref_text(values.parse_ref(p.target))[1:]}"
    head += f" @base={p.base}" if p.base else ""
    lines = [(path_text(o.path), o) for o in p.ops]
    if sort or sort is None and len({t for t, _ in lines}) == len(lines):
        lines.sort(key=lambda x: (x[0].encode(), ord(x[1].op)))
    out = [head]
    for text, o in lines:
        line = f"{indent}{o.op} {text}"
        if o.op in (SET, APPEND):
            line += " " + values.typed(o.value) + (f" @idx={o.index}" if o.op == APPEND and o.index >= 0 else "")
        elif o.op == DELTA:
            number = values.float_text(o.value) if isinstance(o.value, float) else str(o.value)
            line += " " + ("" if number.startswith("-") else "+") + number
        out.append(line)
    return "\n".join([*out, "@end"])


def parse(text: str, schema: Schema | None = None) -> Patch:
    lines = text.strip().split("\n")
    if not lines[0].startswith("@patch"):
        raise values.ValueError_("a patch starts with @patch")
    p = Patch()
    for word in re.findall(r'@(?:schema#\S+|\w+=(?:"(?:[^"\\]|\\.)*"|\S+))', lines[0]):
        if word.startswith("@schema#"):
            p.schema_id = word[8:]
        else:
            name, _, v = word[1:].partition("=")
            if v.startswith('"'):
                v = values.Reader(v).string()
            setattr(p, {"base": "base", "target": "target", "keys": "keys"}.get(name, "_"), v)
    for raw in lines[1:]:
        line = raw.strip()
        if line == "@end":
            return p
        if not line or line.startswith("//"):
            continue
        m = re.match(r"([=+\-~])\s+", line)
        if not m:
            raise values.ValueError_(f"a bad operation: {line}")
        r = values.Reader(line, True, schema)
        r.at = m.end()
        cut = re.compile(r'(?:"(?:[^"\\]|\\.)*"|\[[^\]"]*\]|\["(?:[^"\\]|\\.)*"\]|[^\s"\[])+').match(line, r.at)
        path = parse_path(cut[0])
        r.at = cut.end()
        r.space()
        o = Op(m[1], path)
        if o.op == DELTA:
            o.value = float(line[r.at :])
        elif o.op != DELETE and r.at < len(line):
            o.value = r.value()
            r.space()
            if line.startswith("@idx=", r.at):
                o.index = int(line[r.at + 5 :])
            elif r.at < len(line):
                raise values.ValueError_(f"text after the value: {line}")
        p.ops.append(o)
    raise values.ValueError_("a patch ends with @end")


def resolve_fids(p: Patch, schema: Schema, type_name: str) -> Patch:
    """Field numbers and wire keys of paths as names, down through the types."""
    for o in p.ops:
        kind, out = schema.types.get(type_name), []
        for s in o.path:
            f = kind.field(f"#{s.at}" if s.kind == "fid" else s.at) if kind and s.kind in ("fid", "field") else None
            if s.kind == "fid" and f is None:
                raise values.ValueError_(f"no field #{s.at} in {kind.name if kind else type_name}")
            out.append(Seg("field", f.name) if f else s)
            spec = f.type if f else None
            while spec is not None and spec.kind in ("list", "map"):
                spec = spec.elem
            kind = schema.types.get(spec.name) if spec is not None and spec.kind == "ref" else kind if s.kind == "index" else None
        o.path = out
    return p


def apply(v: Any, p: Patch, verify: bool = False) -> Any:
    """The patched value; ``v`` itself stays as it is. Field and key segments both reach into maps and structs."""
    if verify and p.base and values.patch_base(v) != p.base:
        raise values.ValueError_("the patch is made for another base")
    v = copy.deepcopy(v)
    for o in p.ops:
        v = _apply(v, o.path, o)
    return v


def _inside(v: Any) -> dict[str, Any] | None:
    return v if isinstance(v, dict) else v.fields if isinstance(v, values.Struct) else None


def _apply(v: Any, path: list[Seg], o: Op) -> Any:
    if not path:
        if o.op != SET:
            raise values.ValueError_(f"{o.op} has no place at the root")
        return o.value
    s, rest = path[0], path[1:]
    if s.kind == "fid":
        raise values.ValueError_(f"the field number #{s.at} needs a schema")
    if s.kind == "index":
        if not isinstance(v, list):
            raise values.ValueError_("a list place in what is no list")
        if not 0 <= s.at < len(v) + (o.op == APPEND and not rest):
            raise values.ValueError_(f"the place {s.at} is out of bounds")
        if rest:
            v[s.at] = _apply(v[s.at], rest, o)
        elif o.op == SET:
            v[s.at] = o.value
        elif o.op == APPEND:
            v.insert(s.at, o.value)
        elif o.op == DELETE:
            del v[s.at]
        else:
            v[s.at] = _moved(v[s.at], o.value)
        return v
    d = _inside(v)
    if d is None:
        raise values.ValueError_(f"{s.at!r} in what has no fields")
    if rest:
        if s.at not in d:
            raise values.ValueError_(f"no field {s.at!r}")
        d[s.at] = _apply(d[s.at], rest, o)
    elif o.op == SET:
        d[s.at] = o.value
    elif o.op == DELETE:
        d.pop(s.at, None)
    elif o.op == APPEND:
        old = d.get(s.at, [] if s.at not in d else None)
        if not isinstance(old, list):
            raise values.ValueError_(f"{s.at!r} is no list")
        old.insert(o.index if 0 <= o.index <= len(old) else len(old), o.value)
        d[s.at] = old
    else:
        if s.at not in d:
            raise values.ValueError_(f"no field {s.at!r} to move")
        d[s.at] = _moved(d[s.at], o.value)
    return v


def _moved(old: Any, by: Any) -> Any:
    if isinstance(old, bool) or not isinstance(old, (int, float)):
        raise values.ValueError_("only numbers move")
    if isinstance(old, int):
        if float(by) != int(by):
            raise values.ValueError_(f"{by} would be cut to fit an int")
        return old + int(by)
    return old + by


def diff(a: Any, b: Any) -> Patch:
    """Operations that turn a into b: fields set and deleted, lists replaced whole."""
    p = Patch()

    def walk(x: Any, y: Any, path: list[Seg]) -> None:
        dx, dy = _inside(x), _inside(y)
        if dx is not None and dy is not None and type(x) is type(y) and (isinstance(x, dict) or x.name == y.name):
            kind = "key" if isinstance(x, dict) and path else "field"
            for k in sorted(set(dx) | set(dy)):
                at = [*path, Seg(kind, k)]
                if k not in dy:
                    p.delete(at)
                elif k not in dx:
                    p.set(at, dy[k])
                else:
                    walk(dx[k], dy[k], at)
        elif type(x) is not type(y) or values.typed(x) != values.typed(y):
            p.set(path, y)

    walk(a, b, [])
    return p


# --- columns and tables


def apply_text(doc: Column, patch: Column, schema: Schema | None = None, type_name: str | None = None, verify: bool = False, form: str = "loose") -> Column:
    """Documents (text) with patches (text) applied, in Arrow batches. Gives a struct of ``value`` and ``error``."""

    @F.pandas_udf("value string, error string")
    def run(docs: pd.Series, patches: pd.Series) -> pd.DataFrame:
        out = []
        for d, t in zip(docs, patches, strict=True):
            out.append(_one_patch(d, [t], schema, type_name, verify, form))
        return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    return run(doc, patch)


def _one_patch(doc: str | None, texts: list[str | None], schema: Schema | None, type_name: str | None, verify: bool, form: str) -> tuple[str | None, str | None]:
    if doc is None:
        return None, None
    try:
        v = values.parse(doc, schema=schema)
        for t in texts:
            if t is not None:
                p = parse(t, schema)
                v = apply(v, resolve_fids(p, schema, type_name) if schema and type_name else p, verify)
        return (values.typed(v) if form == "typed" else values.loose(v)), None
    except ValueError as e:
        return None, str(e)


def fold(docs: DataFrame, patches: DataFrame, target: str = "target", seq: str = "seq", text: str = "text", value: str = "value", verify: bool = False) -> DataFrame:
    """Every document with all its patches, in order of ``seq`` (and of the text at ties): ``target, value, error, n_patches``.

    Documents and patches are dealt by target in one shuffle and sorted, a document before its patches; a target is then read as a
    stream, patch after patch, so a document with very many is never gathered in a row. A document without patches comes back in canonical
    form; patches without a document are left out.
    """
    d = docs.select(target, F.lit(0).alias("_kind"), F.lit(None).cast(patches.schema[seq].dataType).alias("_seq"), F.col(value).alias("_text"))
    p = patches.select(target, F.lit(1).alias("_kind"), F.col(seq).alias("_seq"), F.col(text).alias("_text"))
    ddl = f"{target} {docs.schema[target].dataType.simpleString()}, value string, error string, n_patches int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, v, error, n, null, open_ = None, None, None, 0, False, False

        def closed() -> tuple:
            return (key, None if error or null else values.loose(v), error, n)

        for part in parts:
            out = []
            for k, kind, t in zip(part[target], part["_kind"], part["_text"], strict=True):
                if kind == 0:
                    if open_:
                        out.append(closed())
                    key, error, n, null, open_ = k, None, 0, t is None, True
                    try:
                        v = None if null else values.parse(t)
                    except ValueError as e:
                        error = str(e)
                elif open_ and k == key:
                    n += 1
                    if not error and not null and t is not None:
                        try:
                            v = apply(v, parse(t), verify)
                        except ValueError as e:
                            error = str(e)
            yield pd.DataFrame(out, columns=[target, "value", "error", "n_patches"], dtype=object)
        if open_:
            yield pd.DataFrame([closed()], columns=[target, "value", "error", "n_patches"], dtype=object)

    # dealt by number, so that a short table is still parsed by as many tasks
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.unionByName(p).repartition(n, target).sortWithinPartitions(target, "_kind", "_seq", "_text").mapInPandas(run, ddl)


def verify_base(docs: DataFrame, patches: DataFrame, base_of_doc: Column, target: str = "target", base: str = "base") -> DataFrame:
    """Patches with ``base_ok``: whether they name no base or that of the document now. An equi join; null where there is no document."""
    d = docs.select(target, base_of_doc.alias("_base"))
    return patches.join(d, target, "left").withColumn("base_ok", F.when(F.col(base).isNull() | (F.col(base) == ""), True).otherwise(F.col(base) == F.col("_base"))).drop("_base")


def flatten(df: DataFrame, key: str, cols: list[str] | None = None) -> DataFrame:
    """``key, path, value``: a row for each field, nested structs by dotted path, with canonical text."""
    cols = [c for c in cols or df.columns if c != key]
    pairs: list[Column] = []

    def walk(c: Column, t: T.DataType, path: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(c[f.name], f.dataType, f"{path}.{f.name}")
        else:
            pairs.append(F.struct(F.lit(path).alias("path"), loose_text(c, t).alias("value")))

    for c in cols:
        walk(F.col(f"`{c}`"), df.schema[c].dataType, c)
    return df.select(key, F.explode(F.array(*pairs)).alias("_p")).select(key, "_p.path", "_p.value")


def diff_tables(before: DataFrame, after: DataFrame, key: str, cols: list[str] | None = None) -> DataFrame:
    """Operations by row: ``key, op, path, old, new``; ``op`` is ``=`` where a value changed, ``+row`` or ``-row`` where a row came or went.

    Rows meet in one full outer join on the key and are compared field by field inside it; only changed fields are exploded.
    """
    cols = [c for c in cols or before.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*(loose_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in cols)).alias(name))
    j = side(before, "_a").join(side(after, "_b"), key, "full_outer")
    ops = F.array(*(F.when(F.col("_a")[c] != F.col("_b")[c], F.struct(F.lit(SET).alias("op"), F.lit(c).alias("path"), F.col("_a")[c].alias("old"), F.col("_b")[c].alias("new"))) for c in cols))
    whole = lambda op: F.array(F.struct(F.lit(op).alias("op"), F.lit("").alias("path"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    ops = F.when(F.col("_a").isNull(), whole("+row")).when(F.col("_b").isNull(), whole("-row")).otherwise(F.filter(ops, lambda o: o.isNotNull()))
    return j.select(key, F.explode(ops).alias("_o")).select(key, "_o.*")


def emit_patches(ops: DataFrame, key: str, base: Column | None = None) -> DataFrame:
    """Set operations of ``diff_tables`` as one patch text a row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "new"))), lambda o: F.concat(F.lit("= "), o["path"], F.lit(" "), o["new"], F.lit("\n")))
    head = F.concat(F.lit("@patch @keys=name @target="), F.col(key).cast("string"), *([F.lit(" @base="), base] if base is not None else []), F.lit("\n"))
    return ops.where(F.col("op") == SET).groupBy(key).agg(F.array_join(lines, "").alias("_l")).select(key, F.concat(head, F.col("_l"), F.lit("@end")).alias("patch"))


def apply_typed(df: DataFrame, ops: list[tuple[str, str, Any]]) -> DataFrame:
    """A fixed patch on typed columns, without leaving the JVM: (op, dotted path, value or column).

    ``=`` sets, ``~`` adds, ``-`` drops, ``+`` appends to an array. An unknown path fails while the plan is made.
    """
    for op, path, value in ops:
        top, *rest = path.split(".")
        if top not in df.columns and op != SET:
            raise values.ValueError_(f"no column {top}")
        new = value if isinstance(value, Column) else F.lit(value) if value is not None else None
        old = F.col(f"`{top}`")
        for r in rest:
            old = old[r]
        made = {SET: lambda: new, DELTA: lambda: old + new, APPEND: lambda: F.array_append(F.coalesce(old, F.array()), new)}.get(op)
        if op == DELETE:
            df = df.withColumn(top, F.col(f"`{top}`").dropFields(".".join(rest))) if rest else df.drop(top)
        else:
            df = df.withColumn(top, F.col(f"`{top}`").withField(".".join(rest), made()) if rest else made())
    return df


def ops_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each operation of each patch: ``key, pos, op, path, value, idx``."""
    ddl = f"{key} {df.schema[key].dataType.simpleString()}, pos int, op string, path string, value string, idx int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, t in zip(part[key], part[text], strict=True):
                for n, o in enumerate(parse(t).ops if t else []):
                    out.append((k, n, o.op, path_text(o.path), None if o.op == DELETE else values.typed(o.value), o.index))
            yield pd.DataFrame(out, columns=[key, "pos", "op", "path", "value", "idx"])

    return df.select(key, text).mapInPandas(run, ddl)


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))).where("_n = 1").drop("_n")
