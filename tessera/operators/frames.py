"""Framed streams: header text and payload, checks, and cursors over sequence numbers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values

#: The kinds by code, and the limits of a header and of a payload.
KINDS = ("doc", "patch", "row", "ui", "ack", "err", "ping", "pong")
MAX_HEADER, MAX_PAYLOAD = 64 << 10, 64 << 20
#: The machine-readable codes of err payloads and resync requests.
ERROR_CODES = ("BASE_MISMATCH", "SEQ_GAP", "SEQ_DUP", "NO_STATE", "CRC_MISMATCH", "VERSION_UNSUPPORTED", "PAYLOAD_TOO_LARGE", "HEADER_TOO_LARGE", "FRAME_INVALID")
FRAME = "sid decimal(20,0), seq decimal(20,0), kind string, kind_code int, len bigint, payload binary, crc bigint, base string, flags int, final boolean, error string"


def header(sid: Column, seq: Column, kind: Column, payload: Column, crc: bool = True, base: Column | None = None, final: Column | None = None, version: int = 1) -> Column:
    """``@frame{v=1 sid=… seq=… kind=… len=…[ crc=…][ base=sha256:…][ final=true]}``."""
    n = F.coalesce(F.octet_length(payload), F.lit(0))
    parts = [F.lit(f"@frame{{v={version} sid="), sid.cast("string"), F.lit(" seq="), seq.cast("string"), F.lit(" kind="), kind, F.lit(" len="), n.cast("string")]
    if crc:
        parts.append(F.when(n > 0, F.concat(F.lit(" crc="), F.lpad(F.lower(F.hex(F.crc32(payload))), 8, "0"))).otherwise(""))
    if base is not None:
        parts.append(F.when(base.isNotNull(), F.concat(F.lit(" base=sha256:"), base)).otherwise(""))
    if final is not None:
        parts.append(F.when(final, " final=true").otherwise(""))
    return F.concat(*parts, F.lit("}"))


def encode(sid: Column, seq: Column, kind: Column, payload: Column, **how: Any) -> Column:
    """A whole frame as bytes: header line, payload, newline."""
    raw = payload.cast("binary")
    return F.concat(F.concat(header(sid, seq, kind, raw, **how), F.lit("\n")).cast("binary"), F.coalesce(raw, F.lit(b"")), F.lit(b"\n"))


def parse_header(text: Column) -> dict[str, Column]:
    """The header's entries as columns, in the JVM. Missing numbers are 0, as senders leave them out."""
    get = lambda k, p=r"[^\s}]+": F.regexp_extract(text, rf"[{{\s]{k}=({p})", 1)
    num = lambda k, t="decimal(20,0)": F.coalesce(F.try_to_number(F.nullif(get(k, r"\d+"), F.lit("")), F.lit("9" * 20)).cast(t), F.lit(0).cast(t))
    kind = get("kind")
    code = F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1
    return {
        "v": num("v", "int"), "sid": num("sid"), "seq": num("seq"), "kind": kind, "kind_code": F.when(code >= 0, code).otherwise(F.try_to_number(kind, F.lit("999")).cast("bigint")).cast("int"), "len": num("len", "bigint"),
        "crc": F.when(get("crc") != "", F.conv(F.regexp_replace(get("crc"), "^crc32:", ""), 16, 10).cast("bigint")), "base": F.nullif(F.regexp_replace(get("base"), "^sha256:", ""), F.lit("")), "final": get("final") == "true",
    }


_ENTRY = re.compile(rb'([a-z]+)=("[^"]*"|[^\s}]+)')


def split_frames(data: bytes, start: int = 0, strict: bool = False, max_payload: int = MAX_PAYLOAD, check_crc: bool = True) -> tuple[list[tuple], int]:
    """Frames of a byte string from ``start`` (rows of FRAME), and where the first incomplete one begins.

    Faults are named in ``error``; with ``strict`` they raise. After a broken header the rest is one faulty row.
    """
    out, at = [], start
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at, at + MAX_HEADER + 1)
        if end < 0:
            if len(data) - at > MAX_HEADER:
                return out + [_faulty(data[at : at + 64], "HEADER_TOO_LARGE", strict)], len(data)
            return out, at
        line = data[at:end].strip()
        if not line.startswith(b"@frame{") or not line.endswith(b"}"):
            return out + [_faulty(line, "FRAME_INVALID: no frame header", strict)], len(data)
        e = {k.decode(): v.decode().strip('"') for k, v in _ENTRY.findall(line)}
        error = None
        try:
            version, sid, seq, size = (int(e.get(k, d)) for k, d in (("v", 1), ("sid", 0), ("seq", 0), ("len", 0)))
            crc = int(e["crc"].removeprefix("crc32:"), 16) if "crc" in e else None
        except ValueError:
            return out + [_faulty(line, "FRAME_INVALID: a bad number", strict)], len(data)
        if size > max_payload or size < 0:
            return out + [_faulty(line, "PAYLOAD_TOO_LARGE", strict)], len(data)
        if len(data) < end + 1 + size:
            return out, at
        body = data[end + 1 : end + 1 + size]
        at = end + 1 + size
        kind = e.get("kind", "doc")
        code = KINDS.index(kind) if kind in KINDS else int(kind) if kind.isdigit() else -1
        base = e.get("base", "").removeprefix("sha256:") or None
        if version != 1:
            error = "VERSION_UNSUPPORTED"
        elif code < 0 or code >= len(KINDS):
            error = "KIND_UNKNOWN"
        elif base is not None and not re.fullmatch(r"[0-9a-f]{64}", base):
            error = "FRAME_INVALID: a bad base"
        elif check_crc and crc is not None and zlib.crc32(body) != crc:
            error = "CRC_MISMATCH"
        if error and strict:
            raise values.ValueError_(error)
        final = e.get("final") in ("true", "1")
        out.append((sid, seq, kind if code < 0 or code >= len(KINDS) else KINDS[code], code, size, body, crc, base, (1 if crc is not None else 0) | (2 if base else 0) | (4 if final else 0), final, error))
    return out, at


def _faulty(raw: bytes, error: str, strict: bool) -> tuple:
    if strict:
        raise values.ValueError_(error)
    return (None, None, None, -1, len(raw), raw, None, None, 0, False, error)


def decode(df: DataFrame, column: str, **how: Any) -> DataFrame:
    """A row for each frame of each value of a binary column: the other columns, ``pos`` and FRAME. A cut-off last frame is a faulty row."""
    from decimal import Decimal

    others = [c for c in df.columns if c != column]
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others), "pos int", FRAME])
    names = [*others, "pos", *(x.split()[0] for x in re.sub(r"\(20,0\)", "", FRAME).split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, raw in enumerate(part[column]):
                if raw is None:
                    continue
                raw = bytes(raw)
                found, end = split_frames(raw, **how)
                if end < len(raw):
                    found.append(_faulty(raw[end:], "FRAME_INVALID: cut off", False))
                own = [part[c].iloc[k] for c in others]
                rows += [(*own, n, *(Decimal(x) if x is not None else None for x in f[:2]), *f[2:]) for n, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return df.mapInPandas(run, ddl)


def verify_crc(payload: Column, crc: Column) -> Column:
    return crc.isNull() | (F.crc32(payload) == crc)


# --- cursors over a table of frames

#: Code of each status that is a fault.
STATUS_CODES = {"gap": "SEQ_GAP", "duplicate": "SEQ_DUP", "stale": "SEQ_DUP", "no_state": "NO_STATE", "base_mismatch": "BASE_MISMATCH"}
_STATUS = "status string, accepted boolean, last_seq long, missing long"


class Cursor:
    """Where one stream stands: the last accepted number, the last acknowledged one, the state's hash, and whether it has ended.

    Strict: a number not above the last, or above the next, is refused and changes nothing; so is a patch whose base is not the state's hash, or that
    names one where there is no state. Lenient: numbers not above the last are skipped, a gap is told and the frame taken, and a
    base is compared only where there is a state. A stream that stands at 0 takes any number; 0 is no duplicate.
    """

    def __init__(self, lenient: bool = False, last: int = 0, acked: int = 0, state: str | None = None, final: bool = False) -> None:
        self.lenient, self.last, self.acked, self.state, self.final = lenient, last, acked, state, final

    def step(self, seq: int, kind: str | None = None, base: str | None = None, final: bool = False, state: str | None = None) -> tuple[str, bool, int, int]:
        """``status, accepted``, the last number before, and how many are missing. ``state``: the hash after the frame, if it is accepted."""
        before, status, missing = self.last, "ok", 0
        if before and (seq or not self.lenient):
            if seq and seq <= before:
                return ("duplicate" if seq == before else "stale"), False, before, 0
            if seq != before + 1:
                status, missing = "gap", max(0, seq - before - 1)
                if not self.lenient:
                    return status, False, before, missing
        if kind in (None, "patch") and base:
            if self.state is None and not self.lenient:
                return "no_state", False, before, 0
            if self.state is not None and self.state != base:
                return "base_mismatch", False, before, 0
        self.last, self.final = seq, self.final or final
        self.state = state or self.state
        if kind == "ack":
            self.acked = max(self.acked, seq)
        return status, True, before, missing


def cursor(
    df: DataFrame, sid: str = "sid", seq: str = "seq", arrival: str | None = None, kind: str | None = None, base: str | None = None, state: str | None = None, final: str | None = None, lenient: bool = False
) -> DataFrame:
    """Frames with ``status`` (``ok``, ``duplicate``, ``stale``, ``gap``, ``base_mismatch``, ``no_state``), ``accepted``, ``last_seq`` before it, and ``missing``.

    The rules are those of ``Cursor``, in order of ``arrival`` (or of ``seq``); only accepted frames move a stream on. ``state`` is the
    hash of the document after a frame. One shuffle by stream and a sort; a stream is read row by row, never held.
    """
    order = [F.col(arrival)] if arrival else [F.col(seq)]
    ddl = T.StructType([*df.schema.fields, *T._parse_datatype_string(_STATUS).fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, c = None, Cursor(lenient)
        get = lambda part, name, null: [null if pd.isna(x) else x for x in part[name]] if name else [null] * len(part)
        for part in parts:
            out = []
            for k, *x in zip(part[sid], get(part, seq, 0), get(part, kind, None), get(part, base, None), get(part, final, False), get(part, state, None), strict=True):
                if at is None or k != at[0]:
                    at, c = (k,), Cursor(lenient)
                out.append(c.step(int(x[0]), *x[1:]))
            yield part.assign(**dict(zip(("status", "accepted", "last_seq", "missing"), (list(v) for v in zip(*out, strict=True)), strict=True)) if out else {"status": [], "accepted": [], "last_seq": [], "missing": []})

    return df.repartition(sid).sortWithinPartitions(sid, *order).mapInPandas(run, ddl)


def cursor_states(statuses: DataFrame, sid: str = "sid", seq: str = "seq", kind: str | None = None, state: str | None = None, final: str | None = None) -> DataFrame:
    """Where each stream stands after its frames: ``last_seq, last_acked, state, final, needs_resync`` (no state is known) and ``pending`` (numbers not acknowledged).

    In order of ``seq``; a row a stream, so this is also the list of all streams. Partial aggregation, no sort.
    """
    ok = lambda c: F.when(F.col("accepted"), c)
    last = F.coalesce(F.max(ok(F.col(seq))), F.lit(0)).cast("long")
    acked = F.coalesce(F.max(F.when(F.col("accepted") & (F.col(kind) == "ack"), F.col(seq))), F.lit(0)).cast("long") if kind else F.lit(0).cast("long")
    held = F.max_by(state, F.when(F.col("accepted") & F.col(state).isNotNull(), F.col(seq))) if state else F.lit(None).cast("string")
    over = F.coalesce(F.bool_or(ok(F.col(final))), F.lit(False)) if final else F.lit(False)
    d = statuses.groupBy(sid).agg(last.alias("last_seq"), acked.alias("last_acked"), held.alias("state"), over.alias("final"))
    return d.withColumn("needs_resync", F.col("state").isNull()).withColumn("pending", F.greatest(F.col("last_seq") - F.col("last_acked"), F.lit(0).cast("long")))


def dispatch(statuses: DataFrame, handlers: dict[str, Callable[[DataFrame], Any]], kind: str = "kind", final: str = "final") -> dict[str, Any]:
    """What each handler makes of the accepted frames of its kind; the handlers ``gap`` and ``base_mismatch`` get those frames, ``final`` the ended streams' last.

    Works on streams as well: every handler gets a filter of the same frames.
    """
    out = {}
    for name, handle in handlers.items():
        if name in STATUS_CODES:
            d = statuses.where(F.col("status") == name)
        elif name == "final":
            d = statuses.where(F.col("accepted") & F.col(final))
        elif name in KINDS:
            d = statuses.where(F.col("accepted") & (F.col(kind) == name))
        else:
            raise values.ValueError_(f"no frames of the kind {name}")
        out[name] = handle(d)
    return out


def status_code(status: Column) -> Column:
    """The error code of a status; null for ``ok``."""
    return F.coalesce(*(F.when(status == k, v) for k, v in STATUS_CODES.items()))


#: Numbers that one row of ``pending_acks`` spreads at once.
ACK_CHUNK = 10_000


def pending_acks(df: DataFrame, sid: str = "sid", last_acked: str = "last_acked", last_seq: str = "last_seq") -> DataFrame:
    """The numbers of each stream that were sent and not acknowledged. Far ranges are cut into chunks first, so no row holds a long list."""
    a, b = F.col(last_acked).cast("long"), F.col(last_seq).cast("long")
    chunks = df.where(b > a).select(sid, a.alias("a"), b.alias("b")).select(sid, "b", F.explode(F.sequence("a", F.col("b") - 1, F.lit(ACK_CHUNK).cast("long"))).alias("at"))
    return chunks.select(sid, F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + ACK_CHUNK, F.col("b")))).alias("seq"))


def resync_requests(statuses: DataFrame, sid: str = "sid", seq: str = "seq") -> DataFrame:
    """A request for each stream with a gap or a base mismatch: from its first one on."""
    bad = statuses.where(F.col("status").isin("gap", "base_mismatch", "no_state"))
    return bad.groupBy(sid).agg(F.min(seq).alias("seq"), F.min_by("status", seq).alias("reason")).select(
        sid, "seq", ui_event("ResyncRequest", sid=F.col(sid), seq=F.col("seq"), reason=F.col("reason")).alias("payload")
    )


def ui_event(name: str, /, **fields: Column) -> Column:
    """A typed struct for ui and err payloads: ``Progress{msg=… pct=…}``. Strings are written canonically; unsigned numbers beyond a long as strings."""
    from ..functions.canon import string_text

    def text(k: str, c: Column) -> Column:
        whole = F.when(F.typeof(c).startswith("decimal") & (c.cast("decimal(20,0)") > F.lit(2**63 - 1)), F.concat(F.lit('"'), c.cast("string"), F.lit('"'))) if k in ("sid", "seq") else F.lit(None).cast("string")
        plain = F.when(F.typeof(c) == "string", string_text(c.cast("string"))).when(F.typeof(c) == "boolean", F.when(c.cast("string") == "true", "t").otherwise("f")).otherwise(c.cast("string"))
        return F.concat(F.lit(k + "="), F.coalesce(whole, plain, F.lit("∅")))

    return F.concat(F.lit(name + "{"), F.concat_ws(" ", *(text(k, c) for k, c in sorted(fields.items()))), F.lit("}"))


def progress(pct: Column, msg: Column) -> Column:
    return ui_event("Progress", pct=pct.cast("double"), msg=msg)


def log(level: str, msg: Column, ts: Column) -> Column:
    from ..functions.canon import time_text

    return F.concat(F.lit("Log{level="), F.lit(level), F.lit(" msg="), F.regexp_extract(ui_event("X", m=msg), r"\AX\{m=(.*)\}\z", 1), F.lit(" ts="), time_text(ts), F.lit("}"))


def metric(name: Column, value: Column, unit: Column | None = None) -> Column:
    return ui_event("Metric", name=name, value=value.cast("double"), **({"unit": unit} if unit is not None else {}))


def artifact(mime: Column, ref: Column, name: Column) -> Column:
    return ui_event("Artifact", mime=mime, ref=ref, name=name)


def error_event(code: Column, msg: Column, sid: Column, seq: Column) -> Column:
    return ui_event("Error", code=code, msg=msg, sid=sid, seq=seq)
