"""Shared helpers of the training-data operators: inputs, shared scratch tables, Arrow streams."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one batch for Python, and the session's setting for it.
BATCH_BYTES, BATCH_CONF = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words of a text for shingles: everything between ASCII white space.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a session of one machine (unit tests) sets a local folder;
    a cluster raises, since each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = "file://" + os.path.join(tempfile.gettempdir(), "reelframe-shared")
    spark.sparkContext.setCheckpointDir(root)
    return root


def bounded_batches(spark: SparkSession) -> None:
    """Where the session doesn't set it, bound the bytes of a batch for Python."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


class Scratch:
    """Intermediate tables of one query in the shared folder.

    Writing a table cuts the lineage: a lost executor costs a reread, not a rerun of
    everything before. ``drop`` frees tables that nothing reads any more; ``passing`` frees all
    tables that its block begins, once the block has written its result. Other threads' tables
    are theirs.
    """

    _begun: ContextVar[list[str] | None] = ContextVar("scratch", default=None)

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        if (begun := self._begun.get()) is not None:
            begun.append(self.root)
        # Batches for Python are bounded in bytes too, so that very long texts come few at a time.
        bounded_batches(spark)

    @classmethod
    @contextmanager
    def passing(cls, spark: SparkSession) -> Iterator[None]:
        own: list[str] = []
        before = cls._begun.set(own)
        try:
            yield
        finally:
            cls._begun.reset(before)
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            for root in own:
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if at := getattr(df, "_scratch_path", None):
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(conf).delete(path, True)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary())
    return [x or b"" for x in wide.to_pylist()]


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow`` whose freed memory goes back to the system when a task ends: workers live on for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_bytes(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of rows with at most ``most`` bytes together; a larger row stands alone."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at, rows = 0, len(sizes)
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def sliced(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have at most ``most`` bytes together."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for a, b in by_bytes(sizes, most):
        yield batch.slice(a, b - a)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray, copy: bool = True) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits; without ``copy`` in place."""
    x = x.astype(np.uint64, copy=copy)
    spare = np.empty_like(x)
    for m in (_M1, _M2):
        x ^= np.right_shift(x, np.uint64(33), out=spare)
        x *= m
    x ^= np.right_shift(x, np.uint64(33), out=spare)
    return x


_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[bool, np.ndarray] = {}
#: Powers that a worker keeps: 8 MB each way. A longer buffer has its own made.
POWERS_KEPT = 1 << 20


def _power(n: int, inverse: bool) -> np.ndarray:
    have = _powers.get(inverse)
    if have is not None and len(have) >= n:
        return have[:n]
    base = np.full(max(n, POWERS_KEPT), _P_INV if inverse else _P, np.uint64)
    base[0] = 1
    made = np.multiply.accumulate(base)
    if n <= POWERS_KEPT:
        _powers[inverse] = made
    return made[:n]


def words(data: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end) of every run of bytes outside ``is_sep``; vectorised over one buffer."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~is_sep[data]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(len(data), False), out=total[1:])
    h = (total[end] - total[start]) * _power(len(data), True)[start]
    return mix64(h + (end - start).astype(np.uint64)), start, end


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = lower_ascii()
SPACE = byte_set(ASCII_SPACE)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.fill_null("").cast(pa.large_string())
    _, off, data = wide.buffers()
    offsets = np.frombuffer(off, np.int64, len(wide) + 1, wide.offset * 8)
    base = int(offsets[0])
    raw = np.frombuffer(data, np.uint8, int(offsets[-1]) - base, base) if data is not None and offsets[-1] > base else np.empty(0, np.uint8)
    return raw, offsets - base


def fresh(base: str, names: list[str]) -> str:
    """``base`` as a column name that none of ``names`` clashes with, whatever their case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


#: A key with over this part of all rows is hot: at most so many keys are.
HOT_PARTS = 1000


def attach(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``values``, which has one row for each of their keys, null included.

    ``weight``: the rows of a key, ``total``: all rows. The values of hot keys, at most HOT_PARTS
    of them, are broadcast, so that no task gets all rows of one; the others meet in a shuffle.
    """
    hot = F.col(weight) * HOT_PARTS > F.lit(total)
    known = values.withColumnRenamed(key, "_key")
    near = F.broadcast(known.where(hot))
    same = rows[key].eqNullSafe(F.col("_key"))
    often = rows.join(near, same).drop("_key")
    seldom = rows.join(F.broadcast(known.where(hot).select("_key")), same, "left_anti").join(known.where(~hot), same).drop("_key")
    return often.unionByName(seldom)


def first_value(df: DataFrame, default=0):
    row = df.first()
    return default if row is None or row[0] is None else row[0]


def unsigned(column) -> "F.Column":
    return F.when(column < 0, column + F.lit(1 << 32)).otherwise(column)
