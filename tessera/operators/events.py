"""Documents as parse events, for input that comes in pieces: the events don't depend on where it was cut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from .. import values
from .ordered import by_key

_EVENTS = "pos int, event string, path string, key string, value string, type_name string"
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*", re.ASCII)
_SCALAR = re.compile(r"[^\s,(){}\[\]=\"]+")


class EventReader:
    """Feed text, get events: START_OBJECT, END_OBJECT, START_LIST, END_LIST, KEY, VALUE, START_SUM, END_SUM, ERROR.

    A token is taken only once the text after it shows that it has ended. Times and bytes literals are errors here.
    """

    def __init__(self, max_depth: int = values.MAX_DEPTH, max_key: int = 1 << 16, max_value: int = 10 << 20) -> None:
        self.max_depth, self.max_key, self.max_value = max_depth, max_key, max_value
        self.reset()

    def reset(self) -> None:
        self.buffer, self.at, self.count = "", 0, 0
        self.stack: list[list[Any]] = []  # [kind, key or place, waits for: key, sep, value]
        self.failed = self.done = False

    def path(self) -> str:
        out = ""
        for kind, at, _ in self.stack:
            if kind == "list":
                out += f"[{at}]"
            elif kind == "object" and at is not None:
                out += ("." if out else "") + at
        return out

    def _event(self, event: str, key: str | None = None, value: Any = None, type_name: str | None = None, path: str | None = None) -> tuple:
        self.count += 1
        return (self.count - 1, event, self.path() if path is None else path, key, value, type_name)

    def feed(self, text: str) -> Iterator[tuple]:
        """Events (pos, event, path, key, value, type_name); ``value`` is a Python value."""
        self.buffer = self.buffer[self.at :] + text
        self.at = 0
        yield from self._run(False)

    def end(self) -> Iterator[tuple]:
        yield from self._run(True)
        if not self.failed and (self.stack or not self.done):
            self.failed = True
            yield self._event("ERROR", value="the input ends early")

    def _run(self, last: bool) -> Iterator[tuple]:
        while not self.failed:
            while self.at < len(self.buffer) and self.buffer[self.at] in " \t\r\n,":
                self.at += 1
            if self.at >= len(self.buffer):
                return
            try:
                got = list(self._token(last))
            except values.ValueError_ as e:
                self.failed = True
                yield self._event("ERROR", value=str(e))
                return
            if got == [None]:
                return
            yield from got

    def _began(self) -> None:
        """A value begins at this place."""
        if self.stack:
            top = self.stack[-1]
            if top[0] == "list":
                top[1] += 1
            elif top[0] == "object" and top[2] != "value":
                raise values.ValueError_("a value where a key belongs")
            elif top[0] == "sum" and top[2] == "end":
                raise values.ValueError_("a sum holds one value")
        elif self.done:
            raise values.ValueError_("text after the value")
        if len(self.stack) >= self.max_depth:
            raise values.ValueError_("nested too deep")

    def _ended(self) -> None:
        if not self.stack:
            self.done = True
        elif self.stack[-1][0] == "object":
            self.stack[-1][1:] = [None, "key"]
        elif self.stack[-1][0] == "sum":
            self.stack[-1][2] = "end"

    def _token(self, last: bool) -> Iterator[tuple | None]:
        s, at = self.buffer, self.at
        c = s[at]
        top = self.stack[-1] if self.stack else None
        wants_key = top is not None and top[0] == "object" and top[2] == "key"
        if c in "}])":
            kind = {"}": "object", "]": "list", ")": "sum"}[c]
            if top is None or top[0] != kind or kind == "object" and top[2] != "key":
                raise values.ValueError_(f"unexpected {c!r}")
            self.at += 1
            self.stack.pop()
            yield self._event(f"END_{kind.upper()}")
            self._ended()
            return
        if top is not None and top[0] == "object" and top[2] == "sep":
            if c not in "=:":
                raise values.ValueError_("expected '=' or ':'")
            self.at += 1
            top[2] = "value"
            return
        if c == '"':
            end = at + 1
            while end < len(s) and s[end] != '"':
                end += 2 if s[end] == "\\" else 1
            if end >= len(s):
                if len(s) - at > self.max_value:
                    raise values.ValueError_("a string is too long")
                if last:
                    raise values.ValueError_("a string without an end")
                yield None
                return
            text = values.Reader(s[at : end + 1]).string()
            self.at = end + 1
            yield from self._key(text) if wants_key else self._scalar(text)
            return
        if c in "{[":
            if wants_key:
                raise values.ValueError_("expected a key")
            yield from self._open(c, None)
            return
        m = _WORD.match(s, at) or _SCALAR.match(s, at)
        if m is None:
            raise values.ValueError_(f"unexpected {c!r}")
        word = re.compile(r"[^\s,(){}\[\]=\":]+" if wants_key else r"[^\s,(){}\[\]=\"]+").match(s, at)
        text, end = (word or m)[0], (word or m).end()
        if text == "^" and s[end : end + 1] == '"':
            close = re.compile(r'"(?:[^"\\]|\\.)*"').match(s, end)
            if not close:
                if last:
                    raise values.ValueError_("a string without an end")
                yield None
                return
            text, end = s[at : close.end()], close.end()
        if text == "b64":
            raise values.ValueError_("bytes cannot be read in pieces")
        if end >= len(s) and not last:
            if len(text) > (self.max_key if wants_key else self.max_value):
                raise values.ValueError_("a word is too long")
            yield None
            return
        if wants_key:
            if not _WORD.fullmatch(text):
                raise values.ValueError_(f"{text!r} is no key")
            self.at = end
            yield from self._key(text)
            return
        nxt = s[end : end + 1]
        if nxt in ("{", "(") and _WORD.fullmatch(text):
            self.at = end
            yield from self._open(nxt, text)
            return
        self.at = end
        v = values.parse(text)
        if isinstance(v, values.Time):
            raise values.ValueError_("times cannot be read in pieces")
        yield from self._scalar(v)

    def _key(self, text: str) -> Iterator[tuple]:
        if len(text) > self.max_key:
            raise values.ValueError_("a key is too long")
        self.stack[-1][1:] = [text, "sep"]
        yield self._event("KEY", key=text)

    def _scalar(self, v: Any) -> Iterator[tuple]:
        self._began()
        yield self._event("VALUE", value=v)
        self._ended()

    def _open(self, c: str, name: str | None) -> Iterator[tuple]:
        self._began()
        self.at += 1
        kind = {"{": "object", "[": "list", "(": "sum"}[c]
        yield self._event(f"START_{kind.upper()}", type_name=name)
        self.stack.append([kind, -1 if kind == "list" else None, "key" if kind == "object" else "value"])


def events_of(texts: list[str]) -> list[tuple]:
    """All events of a document that comes in several pieces, values as canonical text."""
    r = EventReader()
    out = [e for t in texts for e in r.feed(t)] + list(r.end())
    return [(*e[:4], (e[4] if e[1] == "ERROR" else values.loose(e[4])) if e[1] in ("VALUE", "ERROR") else None, e[5]) for e in out]


def explode_events(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each parse event of each text: ``key, pos, event, path, key, value, type_name`` (``doc`` for the key column). No shuffle."""
    ddl = f"doc {df.schema[key].dataType.simpleString()}, {_EVENTS}"
    names = ["doc", *(x.split()[0] for x in _EVENTS.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(k, *e) for k, t in zip(part[key], part[text], strict=True) if t is not None for e in events_of([t])], columns=names, dtype=object)

    return df.select(key, text).mapInPandas(run, ddl)


def explode_chunks(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """As ``explode_events``, of documents whose pieces are rows: grouped by ``key`` and read in order."""
    ddl = f"doc {df.schema[key].dataType.simpleString()}, {_EVENTS}"
    names = ["doc", *(x.split()[0] for x in _EVENTS.split(", "))]

    def read(k: Any, texts: Iterator[str]) -> list[tuple]:
        return [(k, *e) for e in events_of([t for t in texts if t is not None])]

    return by_key(df, key, order, text, read, ddl, names)
