"""Tool calls: a registry as a table, whole calls checked by joins, streamed calls checked token by token."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values
from .events import EventReader
from .ordered import by_key

REGISTRY = "tool string, arg string, type string, required boolean, min double, max double, min_len int, max_len int, pattern string, enum array<string>"
#: The tools of the two default registries (tool, argument, type, required, min, max, least length, pattern).
SAFE_TOOLS = (
    ("search", "query", "string", True, None, None, 1, None),
    ("search", "max_results", "int", False, 1.0, 100.0, None, None),
    ("calculate", "expression", "string", True, None, None, None, None),
    ("calculate", "precision", "int", False, 0.0, 15.0, None, None),
    ("browse", "url", "string", True, None, None, None, "^https?://"),
)
ALL_TOOLS = SAFE_TOOLS + (
    ("execute", "command", "string", True, None, None, None, None),
    ("read_file", "path", "string", True, None, None, None, None),
    ("read_file", "limit", "int", False, 1.0, None, None, None),
    ("write_file", "path", "string", True, None, None, None, None),
    ("write_file", "content", "string", True, None, None, None, None),
)
MAX_BUFFER, MAX_FIELDS, MAX_ERRORS = 1 << 20, 1000, 100
#: Faults after which a call is not read on.
FATAL = ("UNKNOWN_TOOL", "INVALID_SYNTAX", "LIMIT_EXCEEDED")
_NO_TOOL = "no tool is named"


def registry(spark: SparkSession, tools: tuple = SAFE_TOOLS) -> DataFrame:
    """A registry table; a tool without arguments is a row whose ``arg`` is null."""
    return spark.createDataFrame([(*t[:6], t[6], None, t[7], None) for t in tools], REGISTRY)


def _kind(value: Column) -> Column:
    """The type of an argument's canonical text."""
    return (
        F.when(value.isin("t", "f", "true", "false"), "bool").when(value.rlike(r"\A-?\d+\z"), "int").when(value.rlike(r"\A-?\d+(\.\d+)?([eE][+-]?\d+)?\z"), "float")
        .when(value.startswith("["), "list").when(value.startswith("{"), "map").when(value.isin("_", "∅"), "null").otherwise("string")
    )


def parse_calls(df: DataFrame, key: str, text: str) -> DataFrame:
    """Calls ``tool{arg=value …}`` or ``{action=tool arg=value …}`` as ``key, tool, args`` (map of canonical text), or ``problem``."""

    def one(t: str | None) -> tuple:
        try:
            v = values.parse(t or "")
            if isinstance(v, values.Struct):
                name, args = v.name, v.fields
            elif isinstance(v, dict) and (k := next((k for k in ("action", "tool") if k in v), None)):
                name, args = v[k], {a: x for a, x in v.items() if a != k}
            else:
                return None, None, _NO_TOOL
            return str(name), {a: values.loose(x, values.NO_TABULAR) for a, x in args.items()}, None
        except ValueError as e:
            return None, None, str(e)

    @F.pandas_udf("tool string, args string, problem string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [one(t) for t in s]
        return pd.DataFrame([(a, None if b is None else json.dumps(b), c) for a, b, c in rows], columns=["tool", "args", "problem"], dtype=object)

    d = df.withColumn("_c", run(F.col(text)))
    return d.select(key, F.col("_c.tool").alias("tool"), F.from_json("_c.args", "map<string,string>").alias("args"), F.col("_c.problem").alias("problem"))


def unquoted(c: Column) -> Column:
    """The string that a canonical string's text stands for (simple escapes)."""
    inner = F.regexp_replace(c, r'\A"|"\z', "")
    return F.when(c.startswith('"'), F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(c)


#: Rows of a registry that go to every task at most.
REGISTRY_ROWS = 100_000


def validate_calls(calls: DataFrame, tools: DataFrame, key: str) -> DataFrame:
    """``key, tool, valid, errors`` (sorted codes with their argument) of parsed calls.

    Each call meets its tool's rules, gathered in an array, in one join (broadcast while the registry is short), and is checked in one
    projection: nothing is shuffled.
    """
    columns = ("arg", "type", "required", "min", "max", "min_len", "max_len", "pattern", "enum")
    rules_of = tools.groupBy("tool").agg(F.collect_list(F.when(F.col("arg").isNotNull(), F.struct(*columns))).alias("_rules"))
    rules_of = F.broadcast(rules_of) if tools.count() <= REGISTRY_ROWS else rules_of
    j = calls.join(rules_of, "tool", "left")

    def fault(e: Column) -> Column:
        r = F.try_element_at(F.filter("_rules", lambda r: r["arg"] == e["key"]), F.lit(1))
        value = e["value"]
        kind, num, text = _kind(value), value.try_cast("double"), unquoted(value)
        string = r["type"] == "string"
        code = (
            F.when(r.isNull(), "UNKNOWN_FIELD")
            .when((kind != "null") & ~((kind == r["type"]) | (r["type"] == "float") & (kind == "int")), "INVALID_TYPE")
            .when(num < r["min"], "CONSTRAINT_MIN").when(num > r["max"], "CONSTRAINT_MAX")
            .when(string & ((F.length(text) < r["min_len"]) | (F.length(text) > r["max_len"])), "CONSTRAINT_LEN")
            .when(string & r["pattern"].isNotNull() & ~F.rlike(text, r["pattern"]), "CONSTRAINT_PATTERN")
            .when(string & r["enum"].isNotNull() & ~F.array_contains(r["enum"], text), "CONSTRAINT_ENUM")
        )
        return F.concat(code, F.lit(":"), e["key"])

    none = F.array().cast("array<string>")
    wrong = F.filter(F.transform(F.map_entries("args"), fault), lambda x: x.isNotNull())
    missing = F.transform(F.filter("_rules", lambda r: r["required"] & ~F.map_contains_key(F.col("args"), r["arg"])), lambda r: F.concat(F.lit("MISSING_REQUIRED:"), r["arg"]))
    errors = (
        F.when(F.col("problem").isNotNull(), F.array(F.when(F.col("problem") == _NO_TOOL, "MISSING_TOOL").otherwise("INVALID_SYNTAX")))
        .when(F.col("_rules").isNull(), F.array(F.lit("UNKNOWN_TOOL")))
        .otherwise(F.sort_array(F.concat(F.coalesce(wrong, none), F.coalesce(missing, none))))
    )
    return j.withColumn("errors", errors).select(key, "tool", (F.size("errors") == 0).alias("valid"), "errors")


# --- token by token


@dataclass
class Verdict:
    tool: str | None = None
    tool_token: int = 0
    tool_char: int = 0
    first_error_token: int = 0
    complete_token: int = 0
    tokens: int = 0
    chars: int = 0
    complete: bool = False
    errors: list[str] = field(default_factory=list)
    timeline: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return self.complete and not self.errors

    @property
    def should_stop(self) -> bool:
        """Whether nothing that follows can make the call good: only faults of ``FATAL`` end a call early, others are gathered."""
        return any(e.split(":")[0] in FATAL for e in self.errors)


class TokenValidator:
    """Checks a call while its tokens come; ``tools`` is {tool: {arg: rule dict}}. State is plain data, so it can be kept between batches."""

    def __init__(self, tools: dict[str, dict[str, dict[str, Any]]], max_buffer: int = MAX_BUFFER, max_fields: int = MAX_FIELDS, max_errors: int = MAX_ERRORS) -> None:
        self.tools, self.max_buffer, self.max_fields, self.max_errors = tools, max_buffer, max_fields, max_errors
        self.reset()

    def reset(self) -> None:
        self.reader, self.v = EventReader(), Verdict()
        self.fields: dict[str, Any] = {}
        self.nest: list[Any] = []
        self.key: str | None = None
        self.prefix = False
        self.late: list[tuple[str, Any]] = []

    def _error(self, code: str) -> None:
        if len(self.v.errors) < self.max_errors:
            self.v.errors.append(code)
        self.v.first_error_token = self.v.first_error_token or self.v.tokens
        self.v.timeline.append(f"ERROR@{self.v.tokens}")

    def push(self, token: str) -> Verdict:
        self.v.tokens += 1
        for c in token:
            self.v.chars += 1
            if self.v.should_stop:
                continue
            if self.v.chars > self.max_buffer:
                self._error("LIMIT_EXCEEDED")
                continue
            for e in self.reader.feed(c):
                self._event(e)
        return self.v

    def _tool(self, name: str) -> None:
        self.v.tool, self.v.tool_token, self.v.tool_char = name, self.v.tokens, self.v.chars
        self.v.timeline.append(f"TOOL_DETECTED@{self.v.tokens}")
        if name not in self.tools:
            self._error("UNKNOWN_TOOL")
        for k, x in self.late:
            self._field(k, x)
        self.late = []

    def _event(self, e: tuple) -> None:
        _, event, _, key, value, type_name = e
        if event == "ERROR":
            self._error("INVALID_SYNTAX")
        elif event == "START_OBJECT" and not self.nest:
            self.nest.append({})
            if type_name:
                self._tool(type_name)
        elif event.startswith("START"):
            if not self.nest:
                return self._error("INVALID_SYNTAX")
            self.nest.append([] if event == "START_LIST" else {} if event == "START_OBJECT" else values.Sum(type_name or ""))
            self.nest[-1] = (self.nest[-1], self.key)
            self.key = None
        elif event == "KEY":
            self.key = key
        elif event == "VALUE":
            if not self.nest:
                return self._error("INVALID_SYNTAX")
            self._put(value)
        elif event.startswith("END"):
            done = self.nest.pop()
            if self.nest:
                done, self.key = done
                self._put(done)
            else:
                self._close()

    def _put(self, value: Any) -> None:
        top = self.nest[-1]
        if len(self.nest) == 1:
            k, self.key = self.key, None
            if k in ("action", "tool") and self.v.tool is None and isinstance(value, str):
                self._tool(value)
            elif self.v.tool is None:
                self.late.append((k, value))
            else:
                self._field(k, value)
            return
        box = top[0]
        if isinstance(box, list):
            box.append(value)
        elif isinstance(box, values.Sum):
            box.value = value
        else:
            box[self.key] = value
            self.key = None

    def _field(self, key: str, value: Any) -> None:
        if len(self.fields) >= self.max_fields:
            return self._error("LIMIT_EXCEEDED")
        self.fields[key] = value
        rules = self.tools.get(self.v.tool or "")
        if rules is None:
            return None
        if key not in rules:
            return self._error(f"UNKNOWN_FIELD:{key}")
        code = check_argument(rules[key], value)
        return self._error(f"{code}:{key}") if code else None

    def _close(self) -> None:
        self.v.complete, self.v.complete_token = True, self.v.tokens
        self.v.timeline.append(f"COMPLETE@{self.v.tokens}")
        if self.v.tool is None:
            return self._error("MISSING_TOOL")
        for arg, rule in self.tools.get(self.v.tool, {}).items():
            if rule.get("required") and arg not in self.fields:
                self._error(f"MISSING_REQUIRED:{arg}")
        return None


def check_argument(rule: dict[str, Any], value: Any) -> str | None:
    """The code of the rule that a value breaks."""
    if value is None:
        return None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"string": isinstance(value, str), "int": number and isinstance(value, int), "float": number, "bool": isinstance(value, bool), "list": isinstance(value, list)}
    if not fits.get(rule.get("type", ""), True):
        return "INVALID_TYPE"
    if number and rule.get("min") is not None and value < rule["min"]:
        return "CONSTRAINT_MIN"
    if number and rule.get("max") is not None and value > rule["max"]:
        return "CONSTRAINT_MAX"
    if isinstance(value, str):
        if rule.get("min_len") is not None and len(value) < rule["min_len"] or rule.get("max_len") is not None and len(value) > rule["max_len"]:
            return "CONSTRAINT_LEN"
        if rule.get("pattern") and not re.search(rule["pattern"], value):
            return "CONSTRAINT_PATTERN"
        if rule.get("enum") and value not in rule["enum"]:
            return "CONSTRAINT_ENUM"
    return None


def rules(tools: tuple = SAFE_TOOLS) -> dict[str, dict[str, dict[str, Any]]]:
    """A registry's rows for ``TokenValidator``."""
    out: dict[str, dict[str, dict[str, Any]]] = {}
    for tool, arg, kind, required, lo, hi, least, pattern in tools:
        out.setdefault(tool, {})[arg] = {"type": kind, "required": required, "min": lo, "max": hi, "min_len": least, "pattern": pattern}
    return out


VERDICT = "tool string, tool_token int, tool_char int, first_error_token int, complete_token int, tokens int, chars int, complete boolean, valid boolean, should_stop boolean, errors array<string>"


def verdict_row(v: Verdict) -> tuple:
    return (v.tool, v.tool_token, v.tool_char, v.first_error_token, v.complete_token, v.tokens, v.chars, v.complete, v.valid, v.should_stop, list(v.errors))


def validate_token_table(df: DataFrame, key: str, order: str, token: str, tools: dict | None = None) -> DataFrame:
    """The verdict on each call whose tokens are rows."""
    known = tools or rules()
    names = [key, *(x.split()[0] for x in VERDICT.split(", "))]

    def judge(k: Any, tokens: Any) -> list[tuple]:
        t = TokenValidator(known)
        for x in tokens:
            if t.push(x or "").should_stop:
                break
        return [(k, *verdict_row(t.v))]

    return by_key(df, key, order, token, judge, f"{key} {df.schema[key].dataType.simpleString()}, {VERDICT}", names)
