"""What the training-data operators share: input normalisation, shared tables, Arrow streaming."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that one file of a settled table holds.
FILE_ROWS = 200_000
_made: dict[str, SparkSession] = {}
_held: list[DataFrame] = []
_local: dict[str, str] = {}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that one task ranks at least.
RANKED_ROWS = 250


def ranked_rows(spark: SparkSession, rows: int) -> int:
    """Rows of a bucket whose ranks one task gives: an eighth of a partition's share."""
    return max(RANKED_ROWS, rows // (8 * partitions(spark)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only where all run in one process may it be unset; a local folder then serves."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="shared"))
    return found.rstrip("/")


def hold(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for several readers: cached on the executors' disks, with its lineage, so that what a lost
    executor held is computed again. Freed by ``release``."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    _held.append(df)
    return df


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back. ``rows``, where known, keeps small results in few files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(min(partitions(spark), rows // FILE_ROWS + 1))
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def settle_rows(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` computed once by as many tasks as it has, then written by as few as its rows need: (table, rows).

    The table has no lineage, so plans that use it often stay small.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    rows = held.count()
    out = materialize(held, name, rows)
    held.unpersist()
    return out, rows


def discard(df: DataFrame) -> None:
    """Free a table of ``materialize`` or ``settle_rows`` that nothing reads any more."""
    _delete(df.stored_at)


def _delete(path: str) -> None:
    spark = _made.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is held and written inside is freed at the end, but for tables given to the function this yields."""
    held, made, kept = len(_held), set(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    yield keep
    while len(_held) > held:
        _held.pop().unpersist()
    for path in set(_made) - made - kept:
        _delete(path)


def release(keep: DataFrame | None = None) -> None:
    """Free what operators have held and written, but for the table ``keep``. Results that are still to be read must be stored before."""
    while _held:
        _held.pop().unpersist()
    for path in [p for p in _made if keep is None or p != getattr(keep, "stored_at", None)]:
        _delete(path)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
        return


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """``df`` as one row per document: ``doc_id`` long, ``text`` string, and the columns named in ``keep``.

    A null text is empty. A row without an id names no document and is left out. A document is its id: of rows
    that repeat one, the row with the greatest text stays, and of those the one with the greatest ``keep`` columns
    in their order (a null is least). The repeats are looked for in the ids alone, so tables without any pay no text shuffle.
    """
    keep = [c for c in keep if c not in ("doc_id", "text")]
    d = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep
    )
    if d.groupBy("doc_id").count().where("count > 1").limit(1).count():
        d = d.groupBy("doc_id").agg(F.max(F.struct("text", *keep)).alias("rest")).select("doc_id", "rest.text", *(f"rest.{c}" for c in keep))
    return d


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most ``rows`` rows and about ``limit`` bytes, for work that copies what it reads."""
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * limit // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict] | dict], schema: str) -> DataFrame:
    """``fn`` turns a batch into one dict of columns or several; an empty one is left out."""
    target = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for cols in [out] if isinstance(out, dict) else out:
                    yield to_batch(cols, target)

    return df.mapInArrow(run, schema)


def pa_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def to_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n + 1 bounds of its values. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that are worked on at once, few enough for the caches; a longer text is worked on alone.
CHUNK = 1 << 18


def text_chunks(ids: pa.Array, texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A batch's documents by about ``limit`` bytes: ids, the bytes of their texts end to end, and the bounds of each."""
    data, bounds = utf8(texts)
    all_ids = ids.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(all_ids):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield all_ids[at:to], data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def packed_longs(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype="<i8").tobytes()


#: Rows of ids that go to every task at most: with 8 bytes each, a few MB.
BROADCAST_ROWS = 500_000


def without(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids`` (one column ``doc_id``). A short list is broadcast, so ``df`` is not shuffled; a long one is joined."""
    ids, rows = settle_rows(ids, "ids")
    gone = fresh("gone", df)
    ids = ids.select(F.col("doc_id").alias(gone))
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, F.col(id_col).cast("long") == F.col(gone), "left_anti")


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the splitmix64 finaliser's fixed values


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (or runs of bytes not in ``space``) of texts laid end to end: starts, ends (byte offsets) and the n + 1 bounds of each text's words."""
    edge = np.ones(len(data) + 1, bool)  # edge[i]: no word runs from byte i-1 into byte i
    word = ~space[data] if len(data) else np.zeros(0, bool)
    if len(data):
        edge[1:-1] = ~(word[:-1] & word[1:])
        edge[bounds] = True
    starts = np.flatnonzero(word & edge[:-1])
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


#: Bytes of a word that one number holds.
WORD_BYTES = 8


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word (byte span), the same wherever it lies.

    A word of up to 8 bytes is a number of its own, mixed by bijections; a longer one is digested by XXH3 (128 bits).
    """
    n = ends - starts
    padded = np.zeros(len(data) + WORD_BYTES, np.uint8)
    padded[: len(data)] = data
    whole = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    shift = (WORD_BYTES - np.clip(n, 1, WORD_BYTES)).astype(np.uint64) * np.uint64(8)
    value = (whole[starts] << shift) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    one, two = mix(value), mix(value ^ np.uint64(0xA0761D6478BD642F))
    long_ = np.flatnonzero(n > WORD_BYTES)
    if len(long_):
        raw = memoryview(np.ascontiguousarray(data))
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True)]), "<u8").reshape(-1, 2)
        one[long_], two[long_] = both[:, 0], both[:, 1]
    return one, two


def gram_hashes(word_hash: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words that begin at each word (the last n - 1 have none), from one of the words' hashes."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, seed, np.uint64)
    for k in range(n):
        out = (out ^ word_hash[k : k + count]) * np.uint64(0x2545F4914F6CDD1D)
        out ^= out >> np.uint64(32)
    return mix(out)
