"""Helpers of the training-data operators: tables, shared storage, and numpy views of Arrow text."""

from __future__ import annotations

import atexit
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Base of the polynomial over bytes and over words; odd, so powers can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when this process ends.

    Where that is unset (tests) the home folder of the default file system is used, as its staging folder would be.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = str(jvm.org.apache.hadoop.fs.FileSystem.get(conf).getHomeDirectory()) + "/.sparkStaging"
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            path.getFileSystem(conf).delete(path, True)

    atexit.register(remove)
    return str(path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of fewer rows while the jobs inside run: long rows then take less memory at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def tree_join(rows: DataFrame, dtype: type, join: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Packed arrays of one fixed size, one per row of the one column, joined in a tree; one array reaches the driver.

    Without rows the result is all zeros.
    """
    def both(a: bytes | None, b: bytes | None) -> bytes | None:
        return b if a is None else a if b is None else pack(join(unpack(a, dtype), unpack(b, dtype)))

    total = rows.rdd.treeAggregate(None, lambda a, r: both(a, bytes(r[0])), both, 3)
    return np.zeros(size, dtype) if total is None else unpack(total, dtype)


#: Entries of a piece of an array that ``joined`` puts together.
PIECE = 1 << 16
PIECES = "piece int, part binary"


def pieces(a: np.ndarray) -> pa.RecordBatch:
    """An array as numbered packed pieces, rows of ``PIECES``."""
    parts = [pack(a[i:i + PIECE]) for i in range(0, len(a), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["piece", "part"])


def joined(rows: DataFrame, dtype: type, join: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Arrays of one fixed size, given as ``pieces``, joined entry by entry; one array reaches the driver.

    A piece is joined where all of its number meet, one after another: no process holds two whole arrays, and none but
    the workers of ``mapInArrow`` are started. Without rows the result is all zeros.
    """
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                part = unpack(x.as_py(), dtype)
                if k == at:
                    total = join(total, part)
                    continue
                if at is not None:
                    yield one(at, total)
                at, total = k, part
        if at is not None:
            yield one(at, total)

    def one(k: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(total)], pa.binary())], ["piece", "part"])

    out = np.zeros(size, dtype)
    for k, part in rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(meet, PIECES).collect():
        out[k * PIECE:(k + 1) * PIECE] = unpack(bytes(part), dtype)
    return out


def beside(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_slices(batch: pa.RecordBatch, column: str | int, most: int = 1 << 19, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer text is a run of its own.

    Null texts count as empty. Whole texts only: nothing is cut. ``lower`` folds the case of all letters.
    """
    col = batch.column(column)
    col = (pc.utf8_lower(col) if lower else col).cast(pa.large_binary())
    if col.null_count:
        col = pa.array([x or b"" for x in col.to_pylist()], pa.large_binary())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes: any substring's hash follows from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def word_spans(data: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes outside ``white``; runs end where a text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    after = np.concatenate((solid[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes give equal hashes wherever they stand."""
    sums = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts])


_TABLES: dict[str, np.ndarray] = {}


def category_table(name: str, kinds: dict[str, int]) -> np.ndarray:
    """For every code point the number of its general category's first letter, 0 if it has none; kept under ``name``."""
    if name not in _TABLES:
        _TABLES[name] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    return _TABLES[name]


def byte_kinds(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For every byte of some UTF-8 the table's number of the character it belongs to."""
    kinds = np.where(data < 0x80, table[data], 0).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        b = [more[lead + k] for k in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        tail = [x & 0x3F for x in b]
        two, three = (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]
        kind = table[np.where(size == 2, two, np.where(size == 3, three, (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))]
        for k in range(4):
            kinds[lead[size > k] + k] = kind[size > k]
    return kinds
