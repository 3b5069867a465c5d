"""Token ids as flat unsigned integer files with 64-bit document offsets.

Format: ``part-*.bin`` holds little-endian unsigned ids back to back, two bytes each when
the vocabulary allows it and four otherwise; ``part-*.idx`` holds for each document in
order its doc_id and the 64-bit number of ids before it in the whole corpus, and one closing
pair. Parts follow each other in ascending doc_id order; their bases are the prefix sums of
the parts' totals. Readers map both files into memory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts
from .tokens import Encoder

#: Stands for a missing doc_id in offset files.
NO_ID = -(1 << 63)
INDEX = "part int, doc_id long, local long, n_tokens long, file string, width int"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _open(uri: str, dtype) -> np.ndarray:
    """The file's integers: mapped where it is a local path, read as one stream elsewhere."""
    store, path = _fs(uri)
    if store.type_name == "local":
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_ids(docs: DataFrame, tokenizer: str, target: str, end_id: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """Write ``docs``' ids below ``target`` and return the table of documents: part, doc_id, local, n_tokens, file, base.

    Null and empty texts hold the end id alone; rows with the same doc_id stand side by
    side; rows without doc_id come first. Each task attempt writes files of its own name and
    only the names that reach the index count, so lost executors and repeated attempts leave
    no trace in the result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token-files")
    root = target.rstrip("/")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        kind = np.dtype("<u2") if int(enc.ids.max()) < 1 << 16 else np.dtype("<u4")
        name, store, out, at = f"part-{part:06d}-{uuid.uuid4().hex}.bin", None, None, 0
        for batch in batches:
            doc_ids, done = batch.column(0).to_pylist(), 0
            for some in enc.slices(texts(batch.column(1))):
                if out is None:
                    store, path = _fs(root)
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}")
                ids, first = enc.encode(some)
                where = first[1:]
                flat = np.insert(ids, where, end_id).astype(kind)
                out.write(flat.tobytes())
                n = np.diff(first) + 1
                local = at + np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), part, np.int32)), pa.array(doc_ids[done : done + len(some)], pa.int64()), pa.array(local[:-1]), pa.array(n), pa.array([name] * len(some)), pa.array(np.full(len(some), kind.itemsize, np.int32))],
                    ["part", "doc_id", "local", "n_tokens", "file", "width"],
                )
                at, done = int(local[-1]), done + len(some)
        if out is not None:
            out.close()

    index = scratch.save(rows.mapInArrow(run, INDEX), "index")
    # One row a part comes to the driver: as many as there are files, whatever the corpus.
    totals = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for t in totals:
        bases.append((t["file"], base))
        base += t["n"]
    return index.join(F.broadcast(spark.createDataFrame(bases, "file string, base long")), "file")


def write_offsets(index: DataFrame, target: str) -> DataFrame:
    """Write each part's offset file; returns one row per part: file, documents."""
    root = target.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        files = t.column("file").to_numpy(zero_copy_only=False)
        store, path = _fs(root)
        for f in dict.fromkeys(files):
            on = files == f
            start = (t.column("base").to_numpy() + t.column("local").to_numpy())[on]
            n = t.column("n_tokens").to_numpy()[on]
            ids = t.column("doc_id").fill_null(NO_ID).to_numpy()[on]
            pairs = np.empty((len(ids) + 1, 2), "<i8")
            pairs[:-1, 0], pairs[:-1, 1] = ids, start
            pairs[-1] = (NO_ID, start[-1] + n[-1])
            with store.open_output_stream(f"{path}/{f[:-4]}.idx") as out:
                out.write(pairs.tobytes())
            width = int(t.column("width").to_numpy()[on][0])
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32())], ["file", "docs", "width"])

    dealt = index.select("part", "file", "doc_id", "local", "n_tokens", "base", "width").repartition("file").sortWithinPartitions("file", "local")
    return dealt.mapInArrow(run, "file string, docs long, width int")


def read_ids(files: DataFrame, target: str) -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids_crc32 (of ids as unsigned 32-bit)."""
    root = target.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, width in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs = np.asarray(_open(f"{root}/{f[:-4]}.idx", "<i8")).reshape(-1, 2)
                data = _open(f"{root}/{f}", "<u2" if width == 2 else "<u4")
                at = pairs[:, 1] - pairs[0, 1]
                crc = [zlib.crc32(data[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                ids = pairs[:-1, 0]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(pairs[:-1, 1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "docs", "width").mapInArrow(run, RESULT)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, target: str | None = None) -> DataFrame:
    """Write the files, then read them back."""
    scratch = Scratch(docs.sparkSession, "token-files")
    target = target or scratch.path("ids")
    index = write_ids(docs, tokenizer, target, end_id, scratch)
    files = scratch.save(write_offsets(index, target), "files")
    return read_ids(files.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file"), target)
