"""The value model of untyped documents, with its text readers and writers.

Used inside Arrow functions, where a column's text has a shape known only at run time. Columns with a Spark type
take the expression builders in ``functions`` instead and never come here.

Plain Python values stand for null, bool, int, float, str, bytes, list and map (a dict; the last of equal keys
wins); times, references, structs and sums have a class each.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

MAX_INT = 2**53 - 1
MAX_DEPTH, MAX_ELEMENTS, MAX_STRING = 128, 1_000_000, 10 << 20
#: Words that a bare string may not be.
RESERVED = frozenset("null none nil true false t f _ struct sum list map NaN Inf".split())
BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z", re.ASCII)
REF_SAFE = re.compile(r"[A-Za-z0-9_:.\-]+\Z", re.ASCII)


class ValueError_(ValueError):
    """A text or a value that the format does not allow."""


@dataclass(frozen=True, order=True)
class Time:
    """A UTC instant as text ``YYYY-MM-DDTHH:MM:SS[.fff]Z``; nanoseconds stay."""

    text: str


@dataclass(frozen=True)
class Ref:
    prefix: str
    value: str


@dataclass
class Struct:
    name: str
    fields: dict[str, Any]


@dataclass
class Sum:
    tag: str
    value: Any = None


# --- scalars


def float_text(x: float) -> str:
    """Shortest digits that read back; an exponent from 1e6 and below 1e-4, signed and of two digits at least."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    if x == 0:
        return "0.0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    exp = int(exponent or 0) + len(whole) - 1 - lead
    digits = digits.strip("0") or "0"
    if exp < -4 or exp >= 6:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if exp < 0 else '+'}{abs(exp):02d}"
    if exp < 0:
        return f"{sign}0.{'0' * (-exp - 1)}{digits}"
    if len(digits) <= exp + 1:
        return f"{sign}{digits}{'0' * (exp + 1 - len(digits))}.0"
    return f"{sign}{digits[: exp + 1]}.{digits[exp + 1 :]}"


def quote(s: str, upper: bool = True) -> str:
    out = []
    for c in s:
        if c in '"\\':
            out.append("\\" + c)
        elif c < " ":
            short = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c)
            out.append(short or (f"\\u{ord(c):04X}" if upper else f"\\u{ord(c):04x}"))
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def is_bare(s: str) -> bool:
    return bool(BARE.match(s)) and s not in RESERVED


def string_text(s: str, upper: bool = True) -> str:
    return s if is_bare(s) else quote(s, upper)


def ref_text(r: Ref) -> str:
    whole = f"{r.prefix}:{r.value}" if r.prefix else r.value
    safe = bool(REF_SAFE.match(whole)) and ":" not in r.value
    return "^" + (whole if safe else quote(whole))


def parse_ref(whole: str) -> Ref:
    prefix, colon, value = whole.partition(":")
    return Ref(prefix, value) if colon else Ref("", whole)


def bytes_text(b: bytes) -> str:
    return f'b64"{base64.b64encode(b).decode()}"'


_TIME = re.compile(r"(\d{4}-\d\d-\d\d)(?:T(\d\d:\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?(Z|[+-]\d\d:?\d\d)?)?\Z")


def parse_time(text: str) -> Time | None:
    m = _TIME.match(text)
    if not m:
        return None
    day, clock, second, part, zone = m.groups()
    try:
        t = datetime.fromisoformat(f"{day}T{clock or '00:00'}:{second or '00'}{'+00:00' if zone in (None, 'Z') else zone}").astimezone(UTC)
    except ValueError:
        return None
    part = (part or "").rstrip("0")
    return Time(t.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + ("." + part if part else "") + "Z")


# --- options


@dataclass(frozen=True)
class Options:
    """How the loose text is written."""

    null: str = "_"
    auto_tabular: bool = True
    min_rows: int = 3
    max_cols: int = 20
    allow_missing: bool = True
    keys: tuple[str, ...] = field(default=())

    def replace(self, **changes: Any) -> Options:
        return replace(self, **changes)


DEFAULT = Options()
LLM = Options(null="_")
PRETTY = Options(null="∅")
NO_TABULAR = Options(null="∅", auto_tabular=False)
TABULAR = Options(null="∅")

# --- loose text


def _entries(v: Any) -> dict[str, Any] | None:
    return v if isinstance(v, dict) else v.fields if isinstance(v, Struct) else None


def table_columns(items: list, options: Options) -> list[str] | None:
    """Sorted columns of a list that is written as a table, or None."""
    if len(items) < options.min_rows:
        return None
    every: set[str] = set()
    common: set[str] | None = None
    for item in items:
        entries = _entries(item)
        if not entries:
            return None
        keys = set(entries)
        if not options.allow_missing and common is not None and keys != common:
            return None
        every |= keys
        common = keys if common is None else common & keys
        if len(every) > options.max_cols:
            return None
    if options.allow_missing and 2 * len(common or ()) < len(every):
        return None
    return sorted(every, key=lambda k: string_text(k).encode())


def _key(k: str, options: Options, index: dict[str, int]) -> str:
    return f"#{index[k]}" if k in index else string_text(k)


def loose(v: Any, options: Options = DEFAULT, _index: dict[str, int] | None = None, _depth: int = 0) -> str:
    """Canonical loose text. Struct names are dropped and sums are ``{tag=value}``. NaN and infinities are errors."""
    index = {k: i for i, k in enumerate(options.keys)} if _index is None else _index
    if _depth > MAX_DEPTH:
        raise ValueError_(f"nested deeper than {MAX_DEPTH}")
    if v is None:
        return options.null
    if isinstance(v, bool):
        return "t" if v else "f"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            raise ValueError_("NaN and infinities have no loose form")
        return float_text(v)
    if isinstance(v, str):
        return string_text(v)
    if isinstance(v, bytes):
        return bytes_text(v)
    if isinstance(v, Time):
        return v.text
    if isinstance(v, Ref):
        return ref_text(v)
    deeper = lambda x: loose(x, options, index, _depth + 1)
    if isinstance(v, list):
        if options.auto_tabular and (cols := table_columns(v, options)):
            head = f"@tab _ rows={len(v)} cols={len(cols)} [{' '.join(_key(c, options, index) for c in cols)}]\n"
            rows = []
            for item in v:
                e = _entries(item)
                rows.append("|" + "|".join(deeper(e[c]).replace("|", "\\|") if c in e else options.null for c in cols) + "|\n")
            return head + "".join(rows) + "@end"
        return "[" + " ".join(deeper(x) for x in v) + "]"
    if isinstance(v, Sum):
        return "{" + string_text(v.tag) + "=" + deeper(v.value) + "}"
    entries = sorted((string_text(k).encode(), k, x) for k, x in ((k, None) for k in _entries(v)))
    fields = _entries(v)
    return "{" + " ".join(f"{_key(k, options, index)}={deeper(fields[k])}" for _, k, _ in entries) + "}"


def schema_context_id(keys: list[str]) -> str:
    """The id of a key list: five bytes of the digest of the keys joined by NUL, in lower-case base32."""
    import hashlib

    return base64.b32encode(hashlib.sha256("\0".join(keys).encode()).digest()[:5]).decode().lower()


def key_dictionary(v: Any) -> list[str]:
    """All keys of a value, sorted."""
    found: set[str] = set()

    def walk(x: Any) -> None:
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, Sum):
            walk(x.value)
        elif (e := _entries(x)) is not None:
            found.update(e)
            for y in e.values():
                walk(y)

    walk(v)
    return sorted(found)


def schema_header(keys: list[str], schema_id: str | None = None) -> str:
    return f"@schema#{schema_id or schema_context_id(keys)} @keys=[{' '.join(string_text(k) for k in keys)}]"


def loose_with_schema(v: Any, options: Options = DEFAULT, schema_id: str | None = None) -> str:
    return schema_header(list(options.keys), schema_id) + "\n" + loose(v, options)


def equal(a: Any, b: Any) -> bool:
    return loose(a, NO_TABULAR) == loose(b, NO_TABULAR)


def fingerprint(v: Any) -> str:
    import hashlib

    return hashlib.sha256(loose(v, NO_TABULAR).encode()).hexdigest()


def patch_base(v: Any) -> str:
    import hashlib

    return hashlib.sha256(loose(v).encode()).hexdigest()[:16]


# --- typed text


def typed(v: Any, sort: bool = True, pretty: bool = False, indent: str = "  ", wire: Callable[[str, str], str | None] | None = None, _depth: int = 0) -> str:
    """Typed text: maps ``{k:v}``, structs ``T{k=v}``, sums ``Tag(v)`` or, around a struct, ``Tag{k=v}``. Entries by raw key."""
    if v is None:
        return "∅"
    if isinstance(v, float):
        return float_text(v)
    if isinstance(v, str):
        return string_text(v, upper=False)
    if isinstance(v, (bool, int, bytes, Time, Ref)):
        return loose(v)
    down = lambda x: typed(x, sort, pretty, indent, wire, _depth + 1)
    ordered = lambda d: sorted(d.items(), key=lambda e: e[0].encode()) if sort else list(d.items())

    def body(parts: list[str], left: str, right: str) -> str:
        if not pretty or not parts:
            return left + " ".join(parts) + right
        pad = "\n" + indent * (_depth + 1)
        return left + pad + (" " + pad).join(parts) + "\n" + indent * _depth + right

    if isinstance(v, list):
        return body([down(x) for x in v], "[", "]")
    if isinstance(v, dict):
        return body([f"{string_text(k, upper=False)}:{down(x)}" for k, x in ordered(v)], "{", "}")
    if isinstance(v, Struct):
        return body([f"{(wire and wire(v.name, k)) or k}={down(x)}" for k, x in ordered(v.fields)], v.name + "{", "}")
    if v.value is None:
        return v.tag + "()"
    if isinstance(v.value, Struct):
        return v.tag + "{" + " ".join(f"{k}={down(x)}" for k, x in ordered(v.value.fields)) + "}"
    return f"{v.tag}({typed(v.value, sort, pretty, indent, wire, _depth)})"


# --- JSON


def from_json(text: str, marker: str | None = None) -> Any:
    """JSON text to a value: whole numbers within 2**53 - 1 are ints, others floats. With ``marker``, objects
    ``{marker: "time"|"id"|"bytes", ...}`` are typed scalars and must have exactly their keys."""

    def number(s: str) -> int | float:
        x = float(s)
        if math.isinf(x):
            raise ValueError_(f"number out of range: {s}")
        return int(x) if x.is_integer() and abs(x) <= MAX_INT else x

    def constant(s: str) -> Any:
        raise ValueError_(f"{s} is not JSON")

    def entries(pairs: list[tuple[str, Any]]) -> Any:
        d = dict(pairs)
        return _from_marker(d, marker) if marker and isinstance(d.get(marker), str) else d

    return json.loads(text, parse_float=number, parse_int=number, parse_constant=constant, object_pairs_hook=entries)


def _from_marker(d: dict[str, Any], marker: str) -> Any:
    kind = d[marker]
    key = {"time": "value", "id": "value", "bytes": "base64"}.get(kind)
    if key is None:
        raise ValueError_(f"unknown marker {kind!r}")
    if set(d) != {marker, key} or not isinstance(d[key], str):
        raise ValueError_(f"a {kind} marker has the keys {marker} and {key}, and no others")
    if kind == "time":
        t = parse_time(d[key])
        if t is None:
            raise ValueError_(f"not a time: {d[key]}")
        return t
    if kind == "id":
        return parse_ref(d[key].removeprefix("^"))
    return base64.b64decode(d[key], validate=True)


def to_json(v: Any, marker: str | None = None, indent: int | None = None) -> str:
    """A value as JSON; with ``marker`` its times, references and bytes read back as what they are."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if math.isnan(x) or math.isinf(x):
                raise ValueError_("NaN and infinities are not JSON")
            return int(x) if x.is_integer() and abs(x) <= MAX_INT else x
        if isinstance(x, Time):
            return {marker: "time", "value": x.text} if marker else x.text
        if isinstance(x, Ref):
            return {marker: "id", "value": ref_text(x)} if marker else "^" + (f"{x.prefix}:{x.value}" if x.prefix else x.value)
        if isinstance(x, bytes):
            return {marker: "bytes", "base64": base64.b64encode(x).decode()} if marker else base64.b64encode(x).decode()
        if isinstance(x, list):
            return [plain(y) for y in x]
        if isinstance(x, Sum):
            x = {x.tag: x.value}
        e = _entries(x)
        if e is None:
            return x
        if marker and marker in e:
            raise ValueError_(f"the key {marker!r} is reserved")
        return {k: plain(y) for k, y in sorted(e.items())}

    return json.dumps(plain(v), ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))


def json_equal(a: str, b: str) -> bool:
    return from_json(a) == from_json(b)


# --- reading text


class Reader:
    """Recursive descent over loose, typed and packed text. ``typed_mode`` keeps a lone ``_`` a string and repairs unclosed
    brackets with a warning if ``tolerant``. ``schema`` gives packed structs and typed tables their fields."""

    _NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
    _WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*", re.ASCII)
    _BARE_REF = re.compile(r"[A-Za-z0-9_:.\-]+", re.ASCII)
    _STAMP = re.compile(r"\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?)?")
    _SPACE = re.compile(r"(?:[\s,]+|//[^\n]*)*")

    def __init__(self, text: str, typed_mode: bool = False, schema: Any = None, tolerant: bool = False, keys: list[str] | None = None) -> None:
        self.s, self.at, self.depth, self.count = text, 0, 0, 0
        self.typed_mode, self.schema, self.tolerant, self.keys = typed_mode, schema, tolerant, keys or []
        self.warnings: list[str] = []

    def fail(self, what: str) -> ValueError_:
        line = self.s.count("\n", 0, self.at) + 1
        return ValueError_(f"{what} at line {line}, column {self.at - (self.s.rfind(chr(10), 0, self.at))}")

    def space(self) -> None:
        self.at = self._SPACE.match(self.s, self.at).end()

    def peek(self, n: int = 1) -> str:
        return self.s[self.at : self.at + n]

    def take(self, what: str) -> None:
        if not self.s.startswith(what, self.at):
            raise self.fail(f"expected {what!r}")
        self.at += len(what)

    def whole(self) -> Any:
        """A document: directive lines, then one value, then nothing."""
        self.space()
        while self.s.startswith("@schema", self.at):
            end = self.s.find("\n", self.at)
            end = len(self.s) if end < 0 else end
            got = parse_schema_directive(self.s[self.at : end])
            self.keys = got["keys"] if got["keys"] is not None else [] if got["clear"] else self.keys
            self.at = end
            self.space()
        v = self.value()
        self.space()
        if self.at < len(self.s):
            if not self.tolerant:
                raise self.fail("text after the value")
            self.warnings.append("text after the value")
        return v

    def value(self) -> Any:
        self.space()
        self.count += 1
        if self.count > MAX_ELEMENTS:
            raise self.fail("too many elements")
        c = self.peek()
        if not c:
            raise self.fail("expected a value")
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail(f"nested deeper than {MAX_DEPTH}")
        try:
            return self._value(c)
        finally:
            self.depth -= 1

    def _value(self, c: str) -> Any:
        if c == "{":
            return self.entries("{", "}")
        if c == "[":
            return self.list()
        if c == '"':
            return self.string()
        if c == "^":
            self.at += 1
            if self.peek() == '"':
                return parse_ref(self.string())
            m = self._BARE_REF.match(self.s, self.at)
            if not m:
                raise self.fail("expected a reference")
            self.at = m.end()
            return parse_ref(m[0])
        if c == "∅":
            self.at += 1
            return None
        if c == "@":
            if self.s.startswith("@tab", self.at):
                return self.table()
            raise self.fail("unknown directive")
        if self.s.startswith('b64"', self.at):
            self.at += 3
            try:
                return base64.b64decode(self.string(), validate=True)
            except ValueError as e:
                raise self.fail("bad base64") from e
        if c.isdigit() or c in "+-":
            return self.number()
        m = self._WORD.match(self.s, self.at)
        if not m:
            raise self.fail(f"unexpected {c!r}")
        word = m[0]
        self.at = m.end()
        nxt = self.peek()
        if nxt == "{":
            return Struct(word, self.entries("{", "}")) if not self._is_sum(word) else Sum(word, Struct(word, self.entries("{", "}")))
        if nxt == "(":
            self.at += 1
            self.space()
            if self.peek() == ")":
                self.at += 1
                return Sum(word)
            inner = self.value()
            self.space()
            self.take(")")
            return Sum(word, inner)
        if nxt == "@" and self.peek(2) in ("@(", "@{"):
            return self.packed(word)
        return self.word(word)

    def _is_sum(self, word: str) -> bool:
        return bool(self.schema) and word not in self.schema.types and any(word in {t for t, _ in d.variants} for d in self.schema.types.values() if d.kind == "sum")

    def word(self, word: str) -> Any:
        if word in ("t", "true"):
            return True
        if word in ("f", "false"):
            return False
        if word in ("null", "none", "nil") or word == "_" and not self.typed_mode:
            return None
        if word == "NaN" and self.typed_mode:
            return math.nan
        if word == "Inf" and self.typed_mode:
            return math.inf
        return word

    def number(self) -> Any:
        m = self._STAMP.match(self.s, self.at)
        if m and (t := parse_time(m[0])):
            self.at = m.end()
            return t
        if self.typed_mode and self.s.startswith("-Inf", self.at):
            self.at += 4
            return -math.inf
        m = self._NUMBER.match(self.s, self.at)
        if not m:
            raise self.fail("expected a number")
        self.at = m.end()
        if self._WORD.match(self.s, self.at):
            raise self.fail("a number runs into a word")
        if any(x in m[0] for x in ".eE"):
            return float(m[0])
        n = int(m[0])
        if not -(2**63) <= n < 2**63:
            raise self.fail("an int beyond 64 bits")
        return n

    def string(self) -> str:
        self.take('"')
        out = []
        while True:
            end = self.at
            while end < len(self.s) and self.s[end] not in '"\\':
                end += 1
            out.append(self.s[self.at : end])
            self.at = end
            if end >= len(self.s):
                raise self.fail("a string without an end")
            if self.s[end] == '"':
                self.at += 1
                break
            c = self.s[end + 1 : end + 2]
            self.at += 2
            if c == "u":
                out.append(chr(self._hex()))
                if "\ud800" <= out[-1] <= "\udbff" and self.peek(2) == "\\u":
                    self.at += 2
                    low = self._hex()
                    out[-1] = chr(0x10000 + (ord(out[-1]) - 0xD800 << 10) + low - 0xDC00) if 0xDC00 <= low <= 0xDFFF else "\ufffd\ufffd"
                elif "\ud800" <= out[-1] <= "\udfff":
                    out[-1] = "\ufffd"
            else:
                got = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "|": "|"}.get(c)
                if got is None:
                    raise self.fail(f"unknown escape \\{c}")
                out.append(got)
        text = "".join(out)
        if len(text) > MAX_STRING:
            raise self.fail("a string is too long")
        return text

    def _hex(self) -> int:
        raw = self.peek(4)
        if not re.fullmatch(r"[0-9A-Fa-f]{4}", raw):
            raise self.fail("a bad \\u escape")
        self.at += 4
        return int(raw, 16)

    def list(self) -> list:
        self.take("[")
        out = []
        while True:
            self.space()
            if self.peek() == "]":
                self.at += 1
                return out
            if not self.peek() and self.tolerant:
                self.warnings.append("a list without an end")
                return out
            out.append(self.value())

    def key(self) -> str:
        if self.peek() == '"':
            return self.string()
        if self.peek() == "#":
            m = re.compile(r"#(\d+)").match(self.s, self.at)
            if not m or int(m[1]) >= len(self.keys):
                raise self.fail("a key number without a key")
            self.at = m.end()
            return self.keys[int(m[1])]
        m = re.compile(r"[A-Za-z_][A-Za-z0-9_]*", re.ASCII).match(self.s, self.at)
        if not m:
            raise self.fail("expected a key")
        self.at = m.end()
        return m[0]

    def entries(self, left: str, right: str) -> dict[str, Any]:
        self.take(left)
        out: dict[str, Any] = {}
        while True:
            self.space()
            if self.peek() == right:
                self.at += 1
                return out
            if not self.peek() and self.tolerant:
                self.warnings.append("a map without an end")
                return out
            k = self.key()
            self.space()
            if self.peek() not in ("=", ":"):
                raise self.fail("expected '=' or ':'")
            self.at += 1
            out[k] = self.value()

    def packed(self, name: str) -> Struct:
        kind = self.schema.types.get(name) if self.schema else None
        if kind is None:
            raise self.fail(f"no schema for the packed type {name}")
        self.take("@")
        fields = kind.by_fid()
        if self.peek() == "{":
            m = re.compile(r"\{bm=0b([01]+)\}").match(self.s, self.at)
            if not m or len(m[1]) > 1 << 20:
                raise self.fail("a bad bitmap")
            self.at = m.end()
            optional = [f for f in fields if f.optional]
            bits = m[1][::-1]
            fields = [f for f in fields if not f.optional] + [f for k, f in enumerate(optional) if k < len(bits) and bits[k] == "1"]
        self.take("(")
        out: dict[str, Any] = {}
        for f in fields:
            self.space()
            if self.peek() == ")":
                if not f.optional:
                    raise self.fail(f"the required field {f.name} is missing")
                continue
            v = self.value()
            if not (v is None and f.optional and not f.keep_null):
                out[f.name] = v
        self.space()
        self.take(")")
        return Struct(name, out)

    def table(self) -> list:
        """``@tab _ [...]`` with piped rows, or ``@tab T [...]`` with rows of a schema's type, on lines or, inline, between bars."""
        m = re.compile(r"@tab\s+([A-Za-z_][A-Za-z0-9_]*)((?:\s+[a-z]+=\d+)*)\s*\[").match(self.s, self.at)
        if not m:
            raise self.fail("a bad table header")
        self.at = m.end()
        cols = []
        while True:
            self.space()
            if self.peek() == "]":
                self.at += 1
                break
            cols.append(self.key())
        if m[1] != "_":
            return self._typed_rows(m[1], cols)
        rows: list = []
        while True:
            self.at = re.compile(r"(?:\s+|//[^\n]*)*").match(self.s, self.at).end()
            if self.s.startswith("@end", self.at):
                self.at += 4
                break
            if self.peek() != "|":
                raise self.fail("expected a row or @end")
            end = self.s.find("\n", self.at)
            end = len(self.s) if end < 0 else end
            cells = split_cells(self.s[self.at : end])
            if len(cells) != len(cols):
                raise self.fail(f"a row has {len(cells)} cells, not {len(cols)}")
            self.at = end
            rows.append({c: Reader(cell, self.typed_mode, self.schema, keys=self.keys).whole() for c, cell in zip(cols, cells, strict=True)})
        said = dict(x.split("=") for x in m[2].split())
        if "rows" in said and int(said["rows"]) != len(rows):
            raise self.fail(f"the table says {said['rows']} rows and has {len(rows)}")
        return rows

    def _typed_rows(self, name: str, cols: list[str]) -> list:
        kind = self.schema.types.get(name) if self.schema else None
        if kind is None:
            raise self.fail(f"no schema for the table type {name}")
        fields = [kind.field(c) for c in cols]
        if None in fields:
            raise self.fail(f"unknown column {cols[fields.index(None)]}")
        rows = []
        blank = re.compile(r"(?:[ \t,]+)*")
        while True:
            self.at = re.compile(r"(?:[\s|]+|//[^\n]*)*").match(self.s, self.at).end()
            if self.s.startswith("@end", self.at):
                self.at += 4
                return rows
            if not self.peek():
                raise self.fail("a table without @end")
            out: dict[str, Any] = {}
            for f in fields:
                self.at = blank.match(self.s, self.at).end()
                if self.peek() in ("\n", "|", "") or self.s.startswith("@end", self.at):
                    if not f.optional:
                        raise self.fail(f"the required field {f.name} is missing")
                    continue
                v = self.value()
                if not (v is None and f.optional and not f.keep_null):
                    out[f.name] = v
            self.at = blank.match(self.s, self.at).end()
            if self.peek() not in ("\n", "|", "") and not self.s.startswith("@end", self.at):
                raise self.fail("a row has too many cells")
            rows.append(Struct(name, out))


def split_cells(line: str) -> list[str]:
    """Cells of a piped row. ``\\|`` is a bar; other escapes belong to the cell's own text."""
    body = line.strip()
    if not body.startswith("|") or len(body) < 2 or not body.endswith("|"):
        raise ValueError_("a row starts and ends with a bar")
    return [x.replace("\\|", "|") for x in re.split(r"(?<!\\)\|", body[1:-1])]


def parse_schema_directive(line: str) -> dict[str, Any]:
    """``@schema#id @keys=[...]``, ``@schema#id`` or ``@schema.clear``; ``keys=`` is read as well."""
    line = line.strip()
    if line == "@schema.clear":
        return {"id": None, "keys": None, "clear": True}
    m = re.match(r"@schema#([A-Za-z0-9_]*)\s*(?:@?keys=\[(.*)\])?\s*\Z", line)
    if not m:
        raise ValueError_(f"a bad schema directive: {line}")
    keys = None
    if m[2] is not None:
        r = Reader("[" + m[2] + "]")
        keys = [x if isinstance(x, str) else loose(x) for x in r.list()]
    return {"id": m[1] or None, "keys": keys, "clear": False}


def parse(text: str, typed_mode: bool = False, schema: Any = None, keys: list[str] | None = None) -> Any:
    return Reader(text, typed_mode, schema, keys=keys).whole()


def parse_tolerant(text: str, schema: Any = None) -> tuple[Any, list[str], list[str]]:
    """Typed text as far as it can be read: value, errors, warnings."""
    r = Reader(text, True, schema, tolerant=True)
    try:
        return r.whole(), [], r.warnings
    except ValueError as e:
        return None, [str(e)], r.warnings
