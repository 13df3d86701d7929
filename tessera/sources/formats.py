"""``spark.read.format("tessera_table" | "tessera_frames" | "tessera_value")`` through Spark's Python data sources.

They reach files with pyarrow's file systems. For other stores, ``files`` reads through Spark itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import values
from ..operators import frames


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    base = path[: len(path) - len(at)] if "://" in path else ""
    found = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return [base + f for f in sorted(found)]


def _read(path: str) -> bytes:
    store, at = _open(path)
    with store.open_input_stream(at) as f:
        return f.read()


def _write(path: str, name: str, data: bytes) -> str:
    store, at = _open(path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{name}") as f:
        f.write(data)
    return f"{at}/{name}"


class _Part(InputPartition):
    def __init__(self, path: str, start: int = 0) -> None:
        self.path, self.start = path, start


class _Done(WriterCommitMessage):
    def __init__(self, file: str, rows: int) -> None:
        self.file, self.rows = file, rows


class _FileReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [_Part(f) for f in _files(self.options["path"])]


class _FileWriter(DataSourceWriter):
    """One file a task, named so that a task that runs again overwrites nothing; a failed job's files are removed."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.before = set(_existing(options["path"])) if overwrite else set()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _open(self.options["path"])
        for f in self.before:
            store.delete_file(_open(f)[1])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _open(self.options["path"])
        for m in messages:
            if isinstance(m, _Done):
                store.delete_file(m.file)

    def _name(self, end: str) -> str:
        return f"part-{uuid.uuid4().hex}.{end}"


def _existing(path: str) -> list[str]:
    try:
        return _files(path)
    except (OSError, ValueError):
        return []


def _as(v: Any, t: T.DataType) -> Any:
    """A parsed value as the Python value of a Spark type."""
    if v is None:
        return None
    if isinstance(t, T.StructType):
        d = v.fields if isinstance(v, values.Struct) else v
        return tuple(_as(d.get(f.name), f.dataType) for f in t.fields) if isinstance(d, dict) else None
    if isinstance(t, T.ArrayType):
        return [_as(x, t.elementType) for x in v]
    if isinstance(t, T.MapType):
        return {k: _as(x, t.valueType) for k, x in v.items()}
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else values.loose(v)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(t, T.TimestampType):
        from datetime import datetime

        return datetime.fromisoformat(v.text.replace("Z", "+00:00")) if isinstance(v, values.Time) else None
    return v


class TableSource(DataSource):
    """Files of ``@tab`` tables; the rows' schema must be given. Writes a table a task."""

    @classmethod
    def name(cls) -> str:
        return "tessera_table"

    def schema(self) -> T.StructType:
        raise values.ValueError_("give the rows' schema with .schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TableReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _TableWriter(self.options, overwrite)


class _TableReader(_FileReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        v = values.parse(_read(partition.path).decode())
        for row in v if isinstance(v, list) else [v]:
            yield _as(row, self.schema)


class _TableWriter(_FileWriter):
    """Rows go to the file as they come: the header names the columns and gives no number of rows, which is not known yet."""

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        store, at = _open(self.options["path"])
        store.create_dir(at, recursive=True)
        name, n, cols = f"{at}/{self._name('tab')}", 0, None
        with store.open_output_stream(name) as f:
            for r in rows:
                d = r.asDict(recursive=True)
                if cols is None:
                    cols = sorted(d, key=lambda k: values.string_text(k).encode())
                    f.write(f"@tab _ [{' '.join(map(values.string_text, cols))}]\n".encode())
                cells = (values.loose(_plain(d[c])).replace("|", "\\|") for c in cols)
                f.write(f"|{'|'.join(cells)}|\n".encode())
                n += 1
            f.write(b"@end\n" if n else b"[]\n")
        return _Done(name, n)


def _plain(x: Any) -> Any:
    from datetime import UTC, date, datetime

    if isinstance(x, datetime):
        x = x.astimezone(UTC) if x.tzinfo else x
        return values.parse_time(x.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z")
    if isinstance(x, date):
        return values.parse_time(x.isoformat())
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, list):
        return [_plain(y) for y in x]
    if isinstance(x, dict):
        return {str(k): _plain(y) for k, y in x.items()}
    return x


class ValueSource(DataSource):
    """Files of one value each: ``path, canon, json``. Writes the column ``canon`` (or the only one), a value a file's line."""

    @classmethod
    def name(cls) -> str:
        return "tessera_value"

    def schema(self) -> str:
        return "path string, canon string, json string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ValueReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _ValueWriter(self.options, overwrite)


class _ValueReader(_FileReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        v = values.parse(_read(partition.path).decode())
        yield partition.path, values.loose(v), values.to_json(v)


class _ValueWriter(_FileWriter):
    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        texts = [r["canon"] if "canon" in r.asDict() else r[0] for r in rows]
        return _Done(_write(self.options["path"], self._name("txt"), "".join(t + "\n" for t in texts).encode()), len(texts))


class FrameSource(DataSource):
    """Files of frames, in batch and as a stream; writes frames of rows ``sid, seq, kind, payload[, base, final]``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_frames"

    def schema(self) -> str:
        return "path string, " + frames.FRAME

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FrameReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _FrameStream(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _FrameWriter(self.options, overwrite)


def _rows(path: str, start: int = 0) -> Iterator[tuple]:
    raw = _read(path)
    found, end = frames.split_frames(raw, start)
    if end < len(raw):
        found.append(frames._faulty(raw[end:], "FRAME_INVALID: cut off", False))
    for f in found:
        yield (path, *(Decimal(x) if x is not None else None for x in f[:2]), *f[2:])


class _FrameReader(_FileReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _rows(partition.path)


class _FrameStream(DataSourceStreamReader):
    """The offset is a mark in the files' order of arrival: the newest time of change and the names at it, so it stays short however many files were read.

    Files are whole when they appear, and none appears with an earlier time than those read before.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def _found(self) -> list[tuple[int, str]]:
        return sorted((_changed(f), f) for f in _existing(self.path))

    def initialOffset(self) -> dict:
        return {"time": -1, "files": []}

    def latestOffset(self) -> dict:
        found = self._found()
        if not found:
            return self.initialOffset()
        newest = found[-1][0]
        return {"time": newest, "files": [f for t, f in found if t == newest]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after = lambda t, f: t > start["time"] or t == start["time"] and f not in start["files"]
        until = lambda t, f: t < end["time"] or t == end["time"] and f in end["files"]
        return [_Part(f) for t, f in self._found() if after(t, f) and until(t, f)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _rows(partition.path)

    def commit(self, end: dict) -> None:
        pass


def _changed(path: str) -> int:
    """A file's time of change, in nanoseconds."""
    store, at = _open(path)
    return store.get_file_info(at).mtime_ns or 0


class _FrameWriter(_FileWriter):
    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        import zlib

        out, n = [], 0
        for r in rows:
            d = r.asDict()
            body = bytes(d.get("payload") or b"")
            head = f"@frame{{v=1 sid={d['sid']} seq={d['seq']} kind={d['kind']} len={len(body)}"
            head += f" crc={zlib.crc32(body):08x}" if body and self.options.get("crc", "true") == "true" else ""
            head += (f" base=sha256:{d['base']}" if d.get("base") else "") + (" final=true" if d.get("final") else "")
            out.append(head.encode() + b"}\n" + body + b"\n")
            n += 1
        return _Done(_write(self.options["path"], self._name("frames"), b"".join(out)), n)


def register(spark: SparkSession) -> None:
    for source in (TableSource, ValueSource, FrameSource):
        spark.dataSource.register(source)
