"""Other outside forms: typed JSON with ``$type`` markers, dictionary blobs, dictionary frames, pool documents, document headers."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values
from ..functions.text import _struct, mapped
from ..plans.schema import Schema, TypeSpec

# --- typed JSON

_DATE = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?\Z")


def from_typed_json(text: str, schema: Schema | None = None, type_name: str | None = None, dates: bool = True, refs: bool = True) -> Any:
    """JSON with ``$type, $ref, $time, $bytes, $tag``; strings that look like dates or ``^prefix:value`` are read as such.

    With ``type_name`` an object is a struct of that type, and its fields' types name the structs inside.
    """

    def spec_of(kind: Any, key: str) -> TypeSpec | None:
        f = kind.field(key) if kind else None
        return f.type if f else None

    def struct_of(d: dict, name: str) -> values.Struct:
        kind = schema.types.get(name) if schema else None
        out = {}
        for k, x in d.items():
            if k != "$type":
                f = kind.field(k) if kind else None
                out[f.name if f else k] = walk(x, spec_of(kind, k))
        return values.Struct(name, out)

    def walk(v: Any, spec: TypeSpec | None = None) -> Any:
        if isinstance(v, float) and v.is_integer() and abs(v) <= values.MAX_INT:
            return int(v)
        if isinstance(v, str):
            if refs and v.startswith("^"):
                return values.parse_ref(v[1:])
            return (values.parse_time(v) if dates and _DATE.match(v) else None) or v
        if isinstance(v, list):
            return [walk(x, spec.elem if spec and spec.kind == "list" else None) for x in v]
        if not isinstance(v, dict):
            return v
        if isinstance(v.get("$type"), str):
            return struct_of(v, v["$type"])
        if isinstance(v.get("$ref"), str):
            return values.parse_ref(v["$ref"])
        if isinstance(v.get("$time"), str):
            t = values.parse_time(v["$time"])
            if t is None:
                raise values.ValueError_(f"not a time: {v['$time']}")
            return t
        if isinstance(v.get("$bytes"), str):
            return base64.b64decode(v["$bytes"], validate=True)
        if isinstance(v.get("$tag"), str):
            return values.Sum(v["$tag"], walk(v.get("$value")))
        if spec is not None and spec.kind == "ref":
            return struct_of(v, spec.name)
        return {k: walk(x, spec.elem if spec and spec.kind == "map" else None) for k, x in v.items()}

    return walk(json.loads(text), TypeSpec("ref", name=type_name) if type_name else None)


def to_typed_json(v: Any, schema: Schema | None = None, wire: bool = False) -> str:
    """The inverse, with markers wherever plain JSON would lose the kind."""

    def plain(x: Any) -> Any:
        if isinstance(x, values.Time):
            return {"$time": x.text}
        if isinstance(x, values.Ref):
            return {"$ref": f"{x.prefix}:{x.value}" if x.prefix else x.value}
        if isinstance(x, bytes):
            return {"$bytes": base64.b64encode(x).decode()}
        if isinstance(x, values.Sum):
            return {"$tag": x.tag, "$value": plain(x.value)}
        if isinstance(x, values.Struct):
            kind = schema.types.get(x.name) if schema else None
            name = lambda k: (f.wire or k) if wire and kind and (f := kind.field(k)) else k
            return {"$type": x.name} | {name(k): plain(y) for k, y in x.fields.items()}
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        return [plain(y) for y in x] if isinstance(x, list) else x

    return json.dumps(plain(v), ensure_ascii=False, separators=(",", ":"))


def typed_json_text(c: Column, schema: Schema | None = None, type_name: str | None = None) -> Column:
    """Typed JSON as typed text."""
    return mapped(lambda s: values.typed(from_typed_json(s, schema, type_name)))(c)


def text_typed_json(c: Column, schema: Schema | None = None, wire: bool = False) -> Column:
    return mapped(lambda s: to_typed_json(values.parse(s, True, schema), schema, wire))(c)


# --- dictionaries

#: The blob's magic and the frame's flag for short keys.
MAGIC, COMPACT = b"GDCT", 0x04


def _fnv32(parts: list[bytes]) -> int:
    h = 0x811C9DC5
    for p in parts:
        for b in p:
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def dump_dictionary(keys: list[str], session: int = 0, version: int = 1) -> bytes:
    """Keys in order of their codes, with a checksum."""
    raw = [k.encode() for k in keys]
    return MAGIC + struct.pack("<HHQI", version, len(raw), session, _fnv32(raw)) + b"".join(struct.pack("<H", len(k)) + k for k in raw)


def load_dictionary(data: bytes) -> tuple[list[str], int, int]:
    """Keys, session and version; a short, foreign or damaged blob raises."""
    if len(data) < 20 or data[:4] != MAGIC:
        raise values.ValueError_("no dictionary")
    version, n, session, checksum = struct.unpack("<HHQI", data[4:20])
    at, raw = 20, []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 2], "little")
        raw.append(data[at + 2 : at + 2 + size])
        at += 2 + size
    if at > len(data) or _fnv32(raw) != checksum:
        raise values.ValueError_("a damaged dictionary")
    return [k.decode() for k in raw], session, version


def dictionary_blob(keys: Column, session: Column) -> Column:
    """Key lists as dictionary blobs, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(ks: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else dump_dictionary(list(k), int(i)) for k, i in zip(ks, ids, strict=True)], dtype=object)

    return run(keys, session)


def blob_dictionary(blob: Column) -> Column:
    """A dictionary blob's ``keys``, ``session`` and ``version``; null for a damaged one."""

    def one(b: bytes) -> dict | None:
        try:
            return dict(zip(("keys", "session", "version"), load_dictionary(bytes(b)), strict=True))
        except ValueError:
            return None

    return _struct(one, "keys array<string>, session long, version int")(blob)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise values.ValueError_("the frame ends early")
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7


def encode_frame(v: Any, keys: list[str], session: int = 0, seq: int = 0, version: int = 1) -> bytes:
    """A value with dictionary codes for its keys: flags, session, number, dictionary version, value."""
    code = {k: n for n, k in enumerate(keys)}

    def text(s: str) -> bytes:
        return _varint(len(s.encode())) + s.encode()

    def key(k: str) -> bytes:
        return b"\x80" + struct.pack("<H", code[k]) if k in code else b"\0" + text(k)

    def one(x: Any) -> bytes:
        if isinstance(x, bool):
            return b"\1" if x else b"\2"
        if isinstance(x, int):
            return b"\3" + _varint((x << 1 ^ x >> 63) & 0xFFFFFFFFFFFFFFFF)
        if isinstance(x, float):
            return b"\4" + struct.pack("<d", x)
        if isinstance(x, str):
            return b"\5" + text(x)
        if isinstance(x, list):
            return b"\x10" + _varint(len(x)) + b"".join(map(one, x))
        if isinstance(x, dict):
            return b"\x11" + _varint(len(x)) + b"".join(key(k) + one(y) for k, y in x.items())
        if isinstance(x, values.Struct):
            return b"\x12" + key(x.name) + _varint(len(x.fields)) + b"".join(key(k) + one(y) for k, y in x.fields.items())
        return b"\0"

    return bytes([COMPACT if keys else 0]) + _varint(session) + _varint(seq) + struct.pack("<H", version) + one(v)


def decode_frame(data: bytes, keys: list[str]) -> tuple[Any, int, int]:
    """Value, session and number."""
    r = _Bytes(data)
    r.take(1)
    session, seq = r.varint(), r.varint()
    r.take(2)

    def key() -> str:
        if r.take(1) == b"\x80":
            n = int.from_bytes(r.take(2), "little")
            if n >= len(keys):
                raise values.ValueError_("a key code without a key")
            return keys[n]
        return r.take(r.varint()).decode()

    def one() -> Any:
        tag = r.take(1)[0]
        if tag in (1, 2):
            return tag == 1
        if tag == 3:
            n = r.varint()
            return n >> 1 ^ -(n & 1)
        if tag == 4:
            return struct.unpack("<d", r.take(8))[0]
        if tag == 5:
            return r.take(r.varint()).decode()
        if tag == 0x10:
            return [one() for _ in range(r.varint())]
        if tag == 0x11:
            return {key(): one() for _ in range(r.varint())}
        if tag == 0x12:
            name = key()
            return values.Struct(name, {key(): one() for _ in range(r.varint())})
        return None

    return one(), session, seq


def frame_column(c: Column, keys: list[str], session: int = 0) -> Column:
    """JSON text as dictionary frames, in Arrow batches."""
    return mapped(lambda s: encode_frame(values.from_json(s), keys, session), "binary")(c)


def frame_json(c: Column, keys: list[str]) -> Column:
    return mapped(lambda b: values.to_json(decode_frame(bytes(b), keys)[0]))(c)


# --- key contexts


@dataclass
class KeyRegistry:
    """Key lists by id, the newest active; beyond ``limit`` the one unused for longest goes."""

    limit: int = 64
    known: OrderedDict[str, list[str]] = field(default_factory=OrderedDict)
    active: str | None = None

    def define(self, keys: list[str], schema_id: str | None = None) -> str:
        name = schema_id or values.schema_context_id(keys)
        self.known[name] = keys
        self.known.move_to_end(name)
        self.active = name
        while len(self.known) > self.limit:
            self.known.popitem(last=False)
        return name

    def get(self, schema_id: str) -> list[str] | None:
        if schema_id in self.known:
            self.known.move_to_end(schema_id)
        return self.known.get(schema_id)

    def clear(self) -> None:
        self.active = None

    def read(self, text: str) -> Any:
        """A text whose directives define, choose or clear the active keys."""
        lines = text.lstrip().split("\n")
        while lines and lines[0].startswith("@schema"):
            d = values.parse_schema_directive(lines.pop(0))
            if d["clear"]:
                self.clear()
            elif d["keys"] is not None:
                self.define(d["keys"], d["id"])
            elif d["id"] in self.known:
                self.active = d["id"]
            else:
                raise values.ValueError_(f"unknown keys {d['id']}")
        return values.parse("\n".join(lines), keys=self.get(self.active) if self.active else None)


# --- pool documents


def parse_pools(text: str) -> tuple[dict[str, list[str]], str]:
    """Leading ``@pool.str id=S1 [...]`` blocks, and the text after them."""
    pools: dict[str, list[str]] = {}
    rest = text.lstrip()
    while m := re.match(r"@pool\.str\s+id=(\w+)\s+", rest):
        r = values.Reader(rest)
        r.at = m.end()
        pools[m[1]] = r.list()
        rest = rest[r.at :].lstrip()
    return pools, rest


def read_pool_document(text: str) -> Any:
    """A value whose references ``^S1:N`` stand for strings of the pools before it."""
    pools, rest = parse_pools(text)

    def walk(x: Any) -> Any:
        if isinstance(x, values.Ref) and x.prefix in pools:
            if not x.value.isdigit() or int(x.value) >= len(pools[x.prefix]):
                raise values.ValueError_(f"no entry {x.value} in the pool {x.prefix}")
            return pools[x.prefix][int(x.value)]
        if isinstance(x, list):
            return [walk(y) for y in x]
        if isinstance(x, dict):
            return {k: walk(y) for k, y in x.items()}
        if isinstance(x, values.Struct):
            return values.Struct(x.name, {k: walk(y) for k, y in x.fields.items()})
        return values.Sum(x.tag, walk(x.value)) if isinstance(x, values.Sum) else x

    return walk(values.parse(rest))


def pool_document(v: Any, pool_id: str = "S1", min_length: int = 20, min_count: int = 2) -> str:
    """A value after a pool of its repeated strings: most frequent first, then longest, then in order."""
    n: dict[str, int] = {}

    def count(x: Any) -> None:
        if isinstance(x, str) and len(x.encode()) >= min_length:
            n[x] = n.get(x, 0) + 1
        for y in x if isinstance(x, list) else x.values() if isinstance(x, dict) else x.fields.values() if isinstance(x, values.Struct) else [x.value] if isinstance(x, values.Sum) else []:
            count(y)

    count(v)
    pooled = sorted((s for s, k in n.items() if k >= min_count), key=lambda s: (-n[s], -len(s.encode()), s.encode()))
    if not pooled:
        return values.loose(v, values.NO_TABULAR)
    index = {s: k for k, s in enumerate(pooled)}

    def swap(x: Any) -> Any:
        if isinstance(x, str) and x in index:
            return values.Ref(pool_id, str(index[x]))
        if isinstance(x, list):
            return [swap(y) for y in x]
        if isinstance(x, dict):
            return {k: swap(y) for k, y in x.items()}
        if isinstance(x, values.Struct):
            return values.Struct(x.name, {k: swap(y) for k, y in x.fields.items()})
        return values.Sum(x.tag, swap(x.value)) if isinstance(x, values.Sum) else x

    return f"@pool.str id={pool_id} [{' '.join(values.quote(s) for s in pooled)}]\n" + values.loose(swap(v), values.NO_TABULAR)


def pool_text(c: Column, **how: Any) -> Column:
    """JSON documents with their own pools."""
    return mapped(lambda s: pool_document(values.from_json(s), **how))(c)


def unpool_text(c: Column) -> Column:
    return mapped(lambda s: values.loose(read_pool_document(s), values.NO_TABULAR))(c)


# --- document headers


def document_header(schema: Schema | None = None, mode: str = "auto", keys: str = "wire", version: str = "v2", name: str = "@doc") -> str:
    """``@doc v2 @schema#… @mode=… @keys=…``; ``name`` is the word that the document's readers expect."""
    parts = [f"{name} {version}"] + ([f"@schema#{schema.hash()}"] if schema else [])
    return " ".join([*parts, *([f"@mode={mode}"] if mode != "auto" else []), *([f"@keys={keys}"] if keys != "wire" else [])])


def parse_document_header(c: Column) -> dict[str, Column]:
    """A header line's entries as columns, in the JVM; whatever word leads it."""
    get = lambda k, d: F.coalesce(F.nullif(F.regexp_extract(c, rf"@{k}=(\S+)", 1), F.lit("")), F.lit(d))
    return {"version": F.regexp_extract(c, r"\A@\w+\s+([^@\s]+)", 1), "schema_id": F.nullif(F.regexp_extract(c, r"@schema#(\S+)", 1), F.lit("")), "mode": F.when(get("mode", "auto") == "tab", "tabular").otherwise(get("mode", "auto")), "keys": get("keys", "wire"), "target": F.nullif(F.regexp_extract(c, r"@target=(\S+)", 1), F.lit(""))}
