"""Structured Streaming: cursors, patched documents, token validators and dictionaries kept by key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import values
from ..operators import frames
from ..operators import patch as patches
from ..operators.tools import VERDICT, TokenValidator, rules, verdict_row

_STATUS = "seq long, kind string, status string, accepted boolean, missing long, final boolean"


def cursor_stream(
    df: DataFrame, sid: str = "sid", seq: str = "seq", kind: str = "kind", final: str = "final", base: str | None = None, state_hash: str | None = None, lenient: bool = False, timeout: str | None = None
) -> DataFrame:
    """Each frame's ``status`` by the rules of ``frames.Cursor``, kept between batches; ``frames.dispatch`` deals the accepted ones to handlers.

    Inside a batch frames come in any order, so they are sorted by number. ``base`` names the column with a patch's base and ``state_hash`` the one with the
    document's hash after a frame. An accepted final frame ends the stream and clears its state.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, acked, held = state.get if state.exists else (0, 0, None)
        c = frames.Cursor(lenient, last, acked, held)
        out = []
        batch = pd.concat(list(parts)).sort_values(seq)
        null = lambda r, name: None if name is None or pd.isna(getattr(r, name)) else getattr(r, name)
        for r in batch.itertuples(index=False):
            n, over = int(getattr(r, seq)), bool(getattr(r, final))
            status, accepted, _, missing = c.step(n, getattr(r, kind), null(r, base), over, null(r, state_hash))
            out.append((key[0], n, getattr(r, kind), status, accepted, missing, over))
            if c.final:
                c = frames.Cursor(lenient)
        if c.last or c.state is not None:
            state.update((c.last, c.acked, c.state))
            if timeout:
                state.setTimeoutDuration(timeout)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[sid, "seq", "kind", "status", "accepted", "missing", "final"])

    key_type = df.schema[sid].dataType.simpleString()
    conf = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    cols = list(dict.fromkeys(c for c in (sid, seq, kind, final, base, state_hash) if c))
    return df.select(*cols).groupBy(sid).applyInPandasWithState(run, f"{sid} {key_type}, {_STATUS}", "last long, acked long, state string", "append", conf)


def document_stream(df: DataFrame, sid: str = "sid", seq: str = "seq", kind: str = "kind", payload: str = "payload") -> DataFrame:
    """Documents kept up to date by patch frames: after each ``doc`` or ``patch`` frame ``value``, ``state_hash`` or ``error``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(parts)).sort_values(seq).itertuples(index=False):
            body, error = getattr(r, payload), None
            body = bytes(body).decode() if not isinstance(body, str) else body
            try:
                if getattr(r, kind) == "doc":
                    text = values.loose(values.parse(body))
                elif getattr(r, kind) == "patch":
                    if text is None:
                        raise values.ValueError_("NO_STATE")
                    text = values.loose(patches.apply(values.parse(text), patches.parse(body), verify=True))
                else:
                    continue
            except ValueError as e:
                error = str(e)
            out.append((key[0], int(getattr(r, seq)), None if error else text, None if error else values.patch_base(values.parse(text)), error))
        if text is not None:
            state.update((text,))
        yield pd.DataFrame(out, columns=[sid, "seq", "value", "base", "error"])

    key_type = df.schema[sid].dataType.simpleString()
    return df.select(sid, seq, kind, payload).groupBy(sid).applyInPandasWithState(run, f"{sid} {key_type}, seq long, value string, base string, error string", "text string", "append", GroupStateTimeout.NoTimeout)


def validator_stream(df: DataFrame, key: str = "call_id", order: str = "token_no", token: str = "token", tools: dict[str, Any] | None = None) -> DataFrame:
    """Verdicts on calls whose tokens stream in: a row per batch and call, so that ``should_stop`` can cancel the sender."""
    known = tools or rules()
    names = [key, *(x.split()[0] for x in VERDICT.split(", "))]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = pickle.loads(bytes(state.get[0])) if state.exists else TokenValidator(known)
        for x in pd.concat(list(parts)).sort_values(order)[token]:
            t.push(x or "")
        state.update((pickle.dumps(t),))
        yield pd.DataFrame([(k[0], *verdict_row(t.v))], columns=names)

    return df.select(key, order, token).groupBy(key).applyInPandasWithState(run, f"{key} {df.schema[key].dataType.simpleString()}, {VERDICT}", "state binary", "append", GroupStateTimeout.NoTimeout)


def dictionary_stream(df: DataFrame, session: str, order: str, keys: str, learn: int = 10, limit: int = 4096) -> DataFrame:
    """Key codes by session in order of first sight; after ``learn`` frames the dictionary is frozen and new keys have no code: ``session, key, code``."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, frames = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        codes, out = {x: n for n, x in enumerate(known)}, []
        for ks in pd.concat(list(parts)).sort_values(order)[keys]:
            for x in ks if ks is not None else []:
                if x not in codes and frames < learn and len(codes) < limit:
                    codes[x] = len(codes)
                    known.append(x)
                out.append((k[0], x, codes.get(x)))
            frames += 1
        state.update((known, frames))
        yield pd.DataFrame(out, columns=[session, "key", "code"]).astype({"code": "Int64"})

    return df.select(session, order, keys).groupBy(session).applyInPandasWithState(run, f"{session} {df.schema[session].dataType.simpleString()}, key string, code long", "known array<string>, frames long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(df: DataFrame, ts: str, width: str, late: str, by: str) -> DataFrame:
    """Rows by event-time window and ``by``, with late rows up to ``late``."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))


def event_stream(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Parse events of documents whose pieces stream in: the reader waits in the state for the rest of a token."""
    from ..operators.events import EventReader

    names = ["doc", "pos", "event", "path", "key", "value", "type_name"]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reader = pickle.loads(bytes(state.get[0])) if state.exists else EventReader()
        out = []
        for piece in pd.concat(list(parts)).sort_values(order)[text]:
            for e in reader.feed(piece or ""):
                value = e[4] if e[1] == "ERROR" else values.loose(e[4]) if e[1] == "VALUE" else None
                out.append((k[0], *e[:4], value, e[5]))
        state.update((pickle.dumps(reader),))
        yield pd.DataFrame(out, columns=names, dtype=object)

    return df.select(key, order, text).groupBy(key).applyInPandasWithState(run, f"doc {df.schema[key].dataType.simpleString()}, pos int, event string, path string, key string, value string, type_name string", "state binary", "append", GroupStateTimeout.NoTimeout)
