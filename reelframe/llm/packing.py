"""Best-fit packing with certified bounds.

Token sequences of at most ``capacity`` tokens are filled partition by partition with
best-fit decreasing. Dual feasible functions give each partition a lower bound on its
number of bins; a partition that reaches its bound is certified and final. Partitions with
a gap give up the documents of their least filled bins; those are dealt out anew over fewer
partitions, packed again, and the repacking counts only where it needs fewer bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, released, texts
from .tokens import Encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int, bound long, bins long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (its text's, then ``end_id``).

    Null and empty texts hold the end id alone. A document over ``capacity`` is cut into
    pieces of that length, of which the first may be shorter; all others stay whole.
    Repeated rows give their pieces again. Other columns of ``docs`` are ignored.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(tokenizer)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids, done = batch.column(0).to_pylist(), 0
            for part in enc.slices(texts(batch.column(1))):
                ids, first = enc.encode(part)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for i in range(len(part)):
                    own = np.concatenate((ids[first[i] : first[i + 1]], tail))
                    n = len(own)
                    at, piece = 0, 0
                    size = n if n <= capacity else n % capacity or capacity
                    while at < n:
                        raw = own[at : at + size].astype("<u4", copy=False).tobytes()
                        for k, v in zip(out, (doc_ids[done + i], piece, at, size, zlib.crc32(raw), raw), strict=True):
                            out[k].append(v)
                        at, piece, size = at + size, piece + 1, capacity
                done += len(part)
                cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int32()), pa.array(out["ids_crc32"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(out["ids"], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # u(lambda): items over capacity - lambda count a whole bin, items under lambda nothing.
    for lam in range(1, capacity // 2 + 1, max(1, capacity // 256)):
        big = count[capacity - lam + 1 :].sum()
        mid = (count[lam : capacity - lam + 1] * size[lam : capacity - lam + 1]).sum()
        best = max(best, int(big) - int(-mid // capacity))
    # u(k): rounds an item's share of a bin down to k-ths, exact multiples kept.
    for k in range(1, 21):
        share = size * (k + 1)
        worth = np.where(share % capacity == 0, size * k, (share // capacity) * capacity)
        best = max(best, -(-int((count * worth).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, fill of each bin); items in the given order, which should be by falling length.

    Bins wait in one stack per free space; a bit set of the non-empty stacks gives the
    tightest space that still fits in constant time.
    """
    bins = np.empty(len(lengths), np.int64)
    offs = np.empty(len(lengths), np.int64)
    fill: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i, n in enumerate(lengths.tolist()):
        fits = free >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                free &= ~(1 << space)
        else:
            space, b = capacity, len(fill)
            fill.append(0)
        bins[i], offs[i] = b, fill[b]
        fill[b] += n
        if left := space - n:
            stacks[left].append(b)
            free |= 1 << left
    return bins, offs, np.array(fill, np.int64)


def _pack(df: DataFrame, parts: int, round_no: int, capacity: int, salt: int) -> DataFrame:
    """Each partition's best-fit decreasing, its bound and its number of bins on every row."""
    dealt = df.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64(F.lit(salt), F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32"), F.lit(parts)).cast("int").alias("part"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", F.desc("length"), "doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        part = t.column("part").to_numpy()
        length = t.column("length").to_numpy()
        for p in np.unique(part):
            on = np.flatnonzero(part == p)
            size = length[on]
            bins, offs, fill = best_fit_decreasing(size, capacity)
            seq = (round_no << 56) + (int(p) << 32) + bins
            rows = t.take(pa.array(on)).select(["doc_id", "piece", "start", "length", "ids_crc32"])
            for name, v in (("sequence_id", seq), ("offset", offs.astype(np.int32)), ("bound", np.full(len(on), lower_bound(size, capacity))), ("bins", np.full(len(on), len(fill)))):
                rows = rows.append_column(name, pa.array(v))
            yield from rows.to_batches()

    return dealt.mapInArrow(released(run), PACKED)


def pack(pieces: DataFrame, capacity: int = 2048, per_partition: int = 60_000, rounds: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Sequences for ``pieces`` (doc_id, piece, start, length, ids_crc32), as few as the exchange rounds reach.

    Every piece gets one row with ``sequence_id`` and ``offset``; ``bound`` and ``bins``
    certify the partition that packed it. A partition holds about ``per_partition`` pieces,
    however many there are in all; the deal is by hash, so ties, hot sources and repeated
    rows spread evenly. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    n = pieces.count()
    parts = max(1, -(-n // per_partition))
    now = scratch.save(_pack(pieces, parts, 0, capacity, 0), "packed")
    kept: list[DataFrame] = []
    for r in range(1, rounds + 1):
        # A partition over its bound gives up its bins with room; the full ones are final.
        gaps = now.where(F.col("bins") > F.col("bound"))
        if gaps.select(F.max("bins")).first()[0] is None:
            break
        fill = gaps.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        open_bins = fill.where(F.col("fill") <= int(capacity * 0.98)).select("sequence_id")
        pool = scratch.save(now.join(open_bins, "sequence_id", "left_semi"), "pool")
        stats = pool.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        if not stats[0] or stats[1] < 2:
            break
        fewer = max(1, min(parts // 2, -(-stats[0] // per_partition)))
        again = scratch.save(_pack(pool, fewer, r, capacity, r), "repacked")
        better = again.select(F.countDistinct("sequence_id")).first()[0]
        if better >= stats[1]:
            break
        kept.append(now.join(open_bins, "sequence_id", "left_anti").select(again.columns))
        now, parts = again, fewer
    out = now
    for k in kept:
        out = out.unionByName(k)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack: one row per piece, see ``token_pieces`` and ``pack``."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity, scratch=scratch)
