"""Type schemas: declared once on the driver, compiled to Spark types, projections and checks at plan time."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .. import values

PRIMITIVES = {"null": T.StringType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bytes": T.BinaryType(), "time": T.TimestampType()}
ID_TYPE = T.StructType([T.StructField("prefix", T.StringType()), T.StructField("value", T.StringType())])
#: Levels to which a type that names itself is unrolled in a Spark type.
RECURSION = 4


@dataclass(frozen=True)
class TypeSpec:
    kind: str  # null bool int float str bytes time id list map ref struct
    elem: TypeSpec | None = None
    key: TypeSpec | None = None
    name: str = ""
    inline: tuple = ()

    def __str__(self) -> str:
        if self.kind == "list":
            return f"list<{self.elem}>"
        if self.kind == "map":
            return f"map<{self.key},{self.elem}>"
        return self.name if self.kind == "ref" else self.kind


@dataclass(frozen=True)
class Constraint:
    kind: str  # min max minlen maxlen len regex enum nonempty unique range
    value: Any = None

    def __str__(self) -> str:
        num = lambda x: str(int(x)) if float(x).is_integer() and abs(x) < 1e6 else values.float_text(float(x))
        v = self.value
        return {
            "min": lambda: f"min={num(v)}", "max": lambda: f"max={num(v)}", "minlen": lambda: f"len>={v}", "maxlen": lambda: f"len<={v}", "len": lambda: f"len={v}",
            "regex": lambda: f"regex={values.quote(v)}", "enum": lambda: f"enum=[{' '.join(values.string_text(x) for x in v)}]", "range": lambda: f"{num(v[0])}..{num(v[1])}",
        }.get(self.kind, lambda: self.kind)()


@dataclass
class FieldDef:
    name: str
    type: TypeSpec
    optional: bool = False
    constraints: list[Constraint] = field(default_factory=list)
    fid: int = 0
    wire: str = ""
    codec: str = ""
    keep_null: bool = False
    default: Any = None


@dataclass
class TypeDef:
    name: str
    version: str = ""
    kind: str = "struct"
    fields: list[FieldDef] = field(default_factory=list)
    variants: list[tuple[str, TypeSpec]] = field(default_factory=list)
    pack: bool = False
    tab: bool = False
    open: bool = False

    def by_fid(self) -> list[FieldDef]:
        return sorted(self.fields, key=lambda f: f.fid) if any(f.fid for f in self.fields) else list(self.fields)

    def field(self, key: str) -> FieldDef | None:
        """By name, wire key or ``#fid``."""
        return next((f for f in self.fields if key in (f.name, f.wire or f.name) or f.fid and key == f"#{f.fid}"), None)


@dataclass
class SchemaIssue:
    type_name: str
    field_name: str
    code: str
    message: str


class Schema:
    def __init__(self, types: list[TypeDef] | None = None) -> None:
        self.types: dict[str, TypeDef] = {t.name: t for t in types or []}

    # text

    def text(self) -> str:
        out = ["@schema{"]
        for name in sorted(self.types):
            t = self.types[name]
            head = f"  {t.name}{':' + t.version if t.version else ''} "
            if t.kind == "sum":
                out.append(head + "sum{")
                out += [f"    {tag}: {spec}{' |' if k < len(t.variants) - 1 else ''}" for k, (tag, spec) in enumerate(t.variants)]
            else:
                out.append(head + "".join(f"@{x} " for x in ("pack", "tab", "open") if getattr(t, x)) + "struct{")
                for f in t.fields:
                    marks = [f"[{c}]" for c in f.constraints]
                    marks += [f"@fid({f.fid})"] * (f.fid > 0) + [f"@k({f.wire})"] * bool(f.wire) + [f"@codec({f.codec})"] * bool(f.codec) + ["@keepnull"] * f.keep_null
                    marks += [f"@default({values.typed(f.default)})"] * (f.default is not None) + ["[optional]"] * f.optional
                    out.append("    " + " ".join([f"{f.name}: {f.type}", *marks]))
            out.append("  }")
        return "\n".join([*out, "}"])

    def hash(self, tag: str = "tessera-schema-hash-v1") -> str:
        """32 hex digits of everything that decides the layout: flags, field ids, wire keys, constraints, codecs, defaults.

        ``tag`` leads the preimage; give the producer's own to compare with hashes made elsewhere.
        """
        return hashlib.sha256(self.preimage(tag).encode()).hexdigest()[:32]

    def preimage(self, tag: str = "tessera-schema-hash-v1") -> str:
        b = lambda x: "true" if x else "false"
        out = [tag]
        for name in sorted(self.types):
            t = self.types[name]
            out.append(f"type name={t.name} version={t.version} pack={b(t.pack)} tab={b(t.tab)} open={b(t.open)} kind={t.kind}")
            for f in t.by_fid():
                line = f"  field fid={f.fid} name={f.name} type={f.type} wire={f.wire} opt={b(f.optional)} keepnull={b(f.keep_null)} codec={f.codec}"
                line += f" constraints=[{','.join(sorted(map(str, f.constraints)))}]" if f.constraints else ""
                out.append(line + (f" default={values.typed(f.default)}" if f.default is not None else ""))
            out += [f"  variant tag={tag_} type={spec}" for tag_, spec in sorted(t.variants, key=lambda v: v[0])]
        return "\n".join(out) + "\n"

    def ref(self) -> str:
        return f"@schema#{self.hash()}"

    def assign_fids(self) -> Schema:
        """Number the fields that have no id, after the highest."""
        for t in self.types.values():
            top = max((f.fid for f in t.fields), default=0)
            for f in t.fields:
                if not f.fid:
                    top += 1
                    f.fid = top
        return self

    # checks

    def check(self) -> list[SchemaIssue]:
        out: list[SchemaIssue] = []
        for key, t in self.types.items():
            say = lambda f, code, message: out.append(SchemaIssue(t.name, f, code, message))  # noqa: B023, E731
            if key != t.name:
                out.append(SchemaIssue(key, "", "name_key_mismatch", f"{key} names the type {t.name}"))
            names = [f.name for f in t.fields]
            seen: dict[str, set] = {"name": set(), "wire": set(), "fid": set()}
            for f in t.fields:
                if f.name in seen["name"]:
                    say(f.name, "duplicate_field_name", f"{t.name} has two fields {f.name}")
                seen["name"].add(f.name)
                if f.wire:
                    if f.wire in seen["wire"] or f.wire != f.name and f.wire in names:
                        say(f.name, "duplicate_wire_key", f"the wire key {f.wire} of {t.name}.{f.name} is taken")
                    seen["wire"].add(f.wire)
                if f.fid < 0:
                    say(f.name, "invalid_fid", f"{t.name}.{f.name} has the field id {f.fid}")
                if t.pack and f.fid <= 0:
                    say(f.name, "missing_fid_in_packed_struct", f"{t.name}.{f.name} has no field id")
                elif t.pack:
                    if f.fid in seen["fid"]:
                        say(f.name, "duplicate_fid", f"the field id {f.fid} of {t.name}.{f.name} is taken")
                    seen["fid"].add(f.fid)
                if not f.optional and f.default is not None:
                    say(f.name, "required_field_has_default", f"{t.name}.{f.name} is required and has a default")
                for bad in _bad_map_keys(f.type):
                    say(f.name, "unsupported_map_key_type", f"a map in {t.name}.{f.name} has keys of type {bad}")
                for c in f.constraints:
                    fits = {"min": "int float", "max": "int float", "range": "int float", "regex": "str", "enum": "str", "unique": "list"}.get(c.kind, "str bytes list")
                    if f.type.kind not in fits.split():
                        say(f.name, "constraint_type_mismatch", f"{c} does not fit {t.name}.{f.name} of type {f.type}")
                    if c.kind == "regex" and re.search(r"\(\?[=!<]|\\[1-9]", c.value):
                        say(f.name, "constraint_type_mismatch", f"the pattern of {t.name}.{f.name} looks around or back, which not all engines do")
        return out

    # Spark types

    def struct_type(self, name: str, _depth: int = 0) -> T.StructType:
        """A type as a Spark struct. What Spark has no place for lies in the fields' metadata."""
        t = self.types[name]
        if t.kind == "sum":
            fields = [T.StructField("tag", T.StringType())]
            fields += [T.StructField(f"v_{tag}", self.spark_type(spec, _depth)) for tag, spec in t.variants]
            return T.StructType([*fields[:1], *(T.StructField(f.name, f.dataType, True, {"kind": "sum"}) for f in fields[1:])])
        return T.StructType([T.StructField(f.name, self.spark_type(f.type, _depth), True, self._metadata(f)) for f in t.fields])

    def _metadata(self, f: FieldDef) -> dict[str, Any]:
        kind = {"id": {"kind": "id"}, "ref": {"type_name": f.type.name}}.get(f.type.kind, {})
        return kind | {k: v for k, v in {"fid": f.fid, "wire": f.wire, "codec": f.codec, "optional": f.optional, "keep_null": f.keep_null, "constraints": [str(c) for c in f.constraints]}.items() if v}

    def spark_type(self, spec: TypeSpec, depth: int = 0) -> T.DataType:
        if spec.kind == "list":
            return T.ArrayType(self.spark_type(spec.elem, depth))
        if spec.kind == "map":
            return T.MapType(T.StringType(), self.spark_type(spec.elem, depth))
        if spec.kind == "id":
            return ID_TYPE
        if spec.kind == "struct":
            return T.StructType([T.StructField(f.name, self.spark_type(f.type, depth), True, self._metadata(f)) for f in spec.inline])
        if spec.kind == "ref":
            if spec.name not in self.types or depth >= RECURSION:
                return T.StringType()
            return self.struct_type(spec.name, depth + 1)
        return PRIMITIVES[spec.kind]


def _bad_map_keys(spec: TypeSpec) -> list[str]:
    if spec.kind == "map":
        return ([] if spec.key.kind in ("str", "int", "id") else [str(spec.key)]) + _bad_map_keys(spec.elem)
    return _bad_map_keys(spec.elem) if spec.kind == "list" else []


def spec(text: str) -> TypeSpec:
    return _SchemaReader(text).type()


def of_struct_type(name: str, st: T.StructType, **flags: Any) -> Schema:
    """A schema of a Spark struct; nested structs become types named by their path."""
    types: list[TypeDef] = []

    def one(path: str, dt: T.DataType, meta: dict) -> TypeSpec:
        if isinstance(dt, T.ArrayType):
            return TypeSpec("list", one(path, dt.elementType, {}))
        if isinstance(dt, T.MapType):
            return TypeSpec("map", one(path, dt.valueType, {}), TypeSpec("str"))
        if isinstance(dt, T.StructType):
            if meta.get("kind") == "id":
                return TypeSpec("id")
            add(path, dt)
            return TypeSpec("ref", name=path)
        for kind, cls in (("bool", T.BooleanType), ("int", T.IntegralType), ("float", T.FractionalType), ("bytes", T.BinaryType), ("time", (T.TimestampType, T.DateType, T.TimestampNTZType))):
            if isinstance(dt, cls):
                return TypeSpec(kind)
        return TypeSpec("str")

    def add(path: str, s: T.StructType) -> None:
        t = TypeDef(path, **(flags if path == name else {}))
        t.fields = [FieldDef(f.name, one(f"{path}_{f.name}", f.dataType, f.metadata or {}), f.nullable) for f in s.fields]
        types.append(t)

    add(name, st)
    return Schema(types).assign_fids()


class _SchemaReader:
    _TOKEN = re.compile(r'(?:\s+|//[^\n]*)*("(?:[^"\\]|\\.)*"|\.\.|>=|<=|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?!\.\d)|[A-Za-z_][A-Za-z0-9_.\-]*|\^[A-Za-z0-9_:.\-]+|\S)')

    def __init__(self, text: str) -> None:
        self.tokens: list[str] = []
        at, text = 0, re.sub(r"(\d)\.\.", r"\1 .. ", text).rstrip()
        while at < len(text):
            m = self._TOKEN.match(text, at)
            if not m:
                break
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def take(self, what: str) -> None:
        if (got := self.next()) != what:
            raise values.ValueError_(f"the schema has {got!r} where {what!r} belongs")

    def schema(self) -> Schema:
        self.take("@")
        self.take("schema")
        self.take("{")
        types = []
        while self.peek() not in ("}", ""):
            types.append(self.type_def())
        self.take("}")
        return Schema(types)

    def type_def(self) -> TypeDef:
        t = TypeDef(self.next())
        if self.peek() == ":":
            self.next()
            t.version = self.next()
        while self.peek() == "@":
            self.next()
            flag = self.next()
            if flag not in ("pack", "tab", "open"):
                raise values.ValueError_(f"unknown type flag @{flag}")
            setattr(t, flag, True)
        t.kind = self.next()
        if t.kind == "struct":
            t.fields = self.fields()
        elif t.kind == "sum":
            self.take("{")
            while self.peek() not in ("}", ""):
                tag = self.next()
                self.take(":")
                t.variants.append((tag, self.type()))
                if self.peek() in ("|", ","):
                    self.next()
            self.take("}")
        else:
            raise values.ValueError_(f"{t.name} is neither struct nor sum")
        return t

    def fields(self) -> list[FieldDef]:
        self.take("{")
        out = []
        while self.peek() not in ("}", ""):
            name = self.next()
            optional = self.peek() == "?"
            if optional:
                self.next()
            self.take(":")
            f = FieldDef(name, self.type(), optional)
            while self.peek() in ("[", "@"):
                if self.next() == "[":
                    c = self.constraint()
                    if c.kind == "optional":
                        f.optional = True
                    else:
                        f.constraints.append(c)
                else:
                    self.annotation(f)
            if self.peek() in (",", ";"):
                self.next()
            out.append(f)
        self.take("}")
        return out

    def annotation(self, f: FieldDef) -> None:
        name = self.next()
        if name == "keepnull":
            f.keep_null = True
            return
        self.take("(")
        if name == "default":
            text = self.next()
            f.default = values.parse(text)
        elif name in ("k", "fid", "codec"):
            value = self.next()
            setattr(f, {"k": "wire"}.get(name, name), int(value) if name == "fid" else value)
        else:
            raise values.ValueError_(f"unknown field annotation @{name}")
        self.take(")")

    def constraint(self) -> Constraint:
        word = self.next()
        num = lambda s: float(s) if any(c in s for c in ".eE") else int(s)
        if self.peek() == "..":
            self.next()
            c = Constraint("range", (num(word), num(self.next())))
        elif word in ("optional", "nonempty", "unique"):
            c = Constraint(word)
        elif word in ("min", "max"):
            self.take("=")
            c = Constraint(word, num(self.next()))
        elif word == "len":
            c = Constraint({">=": "minlen", "<=": "maxlen", "=": "len"}[self.next()], int(self.next()))
        elif word == "regex":
            self.take("=")
            c = Constraint("regex", values.parse(self.next()))
        elif word == "enum":
            self.take("=")
            self.take("[")
            items = []
            while self.peek() != "]":
                items.append(str(values.Reader(self.next()).whole()) if self.peek() != "," else self.next())
            self.take("]")
            c = Constraint("enum", tuple(x for x in items if x != ","))
        else:
            raise values.ValueError_(f"unknown constraint {word}")
        self.take("]")
        return c

    def type(self) -> TypeSpec:
        name = self.next()
        if name in ("list", "map"):
            self.take("<")
            first = self.type()
            second = None
            if name == "map":
                self.take(",")
                second = self.type()
            self.take(">")
            return TypeSpec("list", first) if second is None else TypeSpec("map", second, first)
        if name == "struct":
            return TypeSpec("struct", inline=tuple(self.fields()))
        return TypeSpec(name) if name in PRIMITIVES or name == "id" else TypeSpec("ref", name=name)


def parse_schema(text: str) -> Schema:
    return _SchemaReader(text).schema()
