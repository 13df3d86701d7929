"""Abbreviated keys: a dictionary known at plan time, applied to column names or to canonical text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from .. import values
from ..functions.text import mapped


@dataclass
class KeyDict:
    """Full keys and their short forms, one to one."""

    short: dict[str, str] = field(default_factory=dict)

    def add(self, key: str, abbreviation: str) -> KeyDict:
        if abbreviation in self.short.values() and self.short.get(key) != abbreviation:
            raise values.ValueError_(f"{abbreviation!r} is taken")
        self.short[key] = abbreviation
        return self

    def abbreviate(self, key: str) -> str:
        return self.short.get(key, key)

    def expand(self, key: str) -> str:
        return {v: k for k, v in self.short.items()}.get(key, key)

    def merge(self, other: KeyDict) -> KeyDict:
        """Both; of the other's entries only those whose key and short form are free."""
        out = KeyDict(dict(self.short))
        for k, v in other.short.items():
            if k not in out.short and v not in out.short.values():
                out.add(k, v)
        return out

    @classmethod
    def by_rule(cls, keys: list[str]) -> KeyDict:
        """Short forms by rule: initials of the key's words, lengthened by a number where taken."""
        out = cls()
        for k in sorted(keys):
            words = [w for w in k.replace("-", "_").split("_") if w]
            base = "".join(w[0] for w in words).lower() or "k"
            n, name = 1, base
            while name in out.short.values():
                n += 1
                name = f"{base}{n}"
            out.add(k, name)
        return out


#: The short forms that writers and readers of the format agree on, by domain.
LLM_KEYS = KeyDict({
    "content": "c", "role": "r", "messages": "m", "assistant": "a", "system": "s", "user": "u", "function": "fn", "tool": "tl",
    "model": "md", "temperature": "tp", "max_tokens": "mx", "top_p": "pp", "frequency_penalty": "fp", "presence_penalty": "pr", "stop": "st", "stream": "sm", "n": "n",
    "tool_calls": "tc", "tool_call_id": "ti", "function_call": "fc", "name": "nm", "arguments": "ag", "type": "ty",
    "choices": "ch", "message": "mg", "finish_reason": "fr", "usage": "us", "prompt_tokens": "pt", "completion_tokens": "ct", "total_tokens": "tt", "index": "ix", "delta": "dt",
    "id": "id", "object": "ob", "created": "cr", "timestamp": "ts",
})
TOOL_KEYS = KeyDict({
    "type": "ty", "properties": "p", "required": "rq", "description": "d", "default": "df", "enum": "en", "items": "it", "minimum": "mn", "maximum": "mx", "minLength": "ml", "maxLength": "xl", "pattern": "pt", "format": "fm",
    "oneOf": "oo", "anyOf": "ao", "allOf": "al", "additionalProperties": "ap",
    "string": "s", "number": "n", "integer": "i", "boolean": "b", "array": "a", "object": "o", "null": "z",
    "name": "nm", "parameters": "pm", "returns": "rt",
})
ML_KEYS = KeyDict({
    "shape": "sh", "dtype": "dt", "data": "da", "strides": "st", "offset": "of", "device": "dv",
    "float32": "f32", "float64": "f64", "float16": "f16", "bfloat16": "bf16", "int32": "i32", "int64": "i64", "int8": "i8", "uint8": "u8",
    "weights": "w", "bias": "bi", "input": "in", "output": "ou", "hidden": "hi", "embedding": "em", "attention": "at", "layer": "ly", "norm": "no", "activation": "ac", "dropout": "dr", "gradient": "gr", "loss": "lo", "optimizer": "op",
    "learning_rate": "lr", "batch_size": "bs", "epochs": "ep",
})
ALL_KEYS = LLM_KEYS.merge(TOOL_KEYS).merge(ML_KEYS)


def _renamed(v, name):
    if isinstance(v, dict):
        return {name(k): _renamed(x, name) for k, x in v.items()}
    if isinstance(v, values.Struct):
        return values.Struct(v.name, {name(k): _renamed(x, name) for k, x in v.fields.items()})
    if isinstance(v, values.Sum):
        return values.Sum(v.tag, _renamed(v.value, name))
    return [_renamed(x, name) for x in v] if isinstance(v, list) else v


def abbreviate_text(c: Column, keys: KeyDict, omit: dict | None = None) -> Column:
    """Texts with short keys; entries that equal their default in ``omit`` are left out (top level)."""

    def one(s: str) -> str:
        v = values.parse(s)
        if omit and isinstance(v, dict):
            v = {k: x for k, x in v.items() if k not in omit or omit[k] != x}
        return values.loose(_renamed(v, keys.abbreviate))

    return mapped(one)(c)


def expand_text(c: Column, keys: KeyDict) -> Column:
    return mapped(lambda s: values.loose(_renamed(values.parse(s), keys.expand)))(c)


def abbreviate_columns(df: DataFrame, keys: KeyDict) -> DataFrame:
    return df.withColumnsRenamed({c: keys.abbreviate(c) for c in df.columns})


def expand_columns(df: DataFrame, keys: KeyDict) -> DataFrame:
    return df.withColumnsRenamed({c: keys.expand(c) for c in df.columns})
