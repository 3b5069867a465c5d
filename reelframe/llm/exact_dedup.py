"""Exact dedup against a minimal perfect hash of historical distinct digests.

The index is built bucket by bucket: the digests of a bucket get a hash-and-displace
function that sends each to its own slot of a table without empty slots; a slot holds the
full digest and the winner's locator. A lookup computes the slot and compares the 32 digest
bytes, so a text that history doesn't hold never passes for a member; such nonmembers are
grouped among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, texts

DIGEST = 32
#: Digests of a bucket, about; a bucket's table is held by the task that looks up in it.
BUCKET = 1_000
#: A digest with more than this share of all rows is dealt over several copies of its bucket.
HOT_SHARE = 1 / 1000


class PerfectHash:
    """Slots 0..n-1 for n distinct digests: displacement per group of about four keys, most crowded group first."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @staticmethod
    def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = digests.reshape(-1, DIGEST).view("<u8")
        return w[:, 0], w[:, 1], w[:, 2] | np.uint64(1)

    @staticmethod
    def _slot(b: np.ndarray, c: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
        h = b + c * seed.astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return (h % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> "PerfectHash":
        a, b, c = cls._parts(digests)
        n = len(a)
        groups = max(1, n // 4)
        group = (a % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        count = np.bincount(group, minlength=groups)
        first = np.concatenate(([0], np.cumsum(count)))
        seeds = np.zeros(groups, np.int64)
        taken = np.zeros(n, bool)
        tries = np.arange(256)
        for g in np.argsort(-count, kind="stable").tolist():
            if not count[g]:
                break
            own = order[first[g] : first[g + 1]]
            base = 0
            while True:
                seed = tries + base
                slots = cls._slot(b[own][:, None], c[own][:, None], seed[None, :], n)
                good = ~taken[slots].any(axis=0)
                if len(own) > 1:
                    s = np.sort(slots, axis=0)
                    good &= (s[1:] != s[:-1]).all(axis=0)
                if good.any():
                    k = int(good.argmax())
                    seeds[g] = seed[k]
                    taken[slots[:, k]] = True
                    break
                base += len(tries)
                if base > 1 << 24:
                    raise ValueError("digests aren't distinct")
        return cls(seeds, n)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        a, b, c = self._parts(digests)
        return self._slot(b, c, self.seeds[(a % np.uint64(len(self.seeds))).astype(np.int64)], self.n)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each whole text in UTF-8, A-Z lower-cased; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashlib.sha256(t.lower()).digest() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, digest binary")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: bucket, seeds, slots (digests), keep, size (arrays by slot).

    ``history``: distinct digests with their winner's locator ``keep`` and ``size``, the
    rows that share the digest.
    """
    dealt = history.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(key: int, some: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(some)
            d = np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
            h = PerfectHash.build(d)
            at = np.empty(len(d), np.int64)
            at[h.slots(d)] = np.arange(len(d))
            keep = t.column("keep").combine_chunks().fill_null(NO_ID).to_numpy()[at]
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int32()), pa.array([h.seeds.tobytes()]), pa.array([d[at].tobytes()]), pa.array([keep.tobytes()]), pa.array([t.column("size").to_numpy()[at].tobytes()])],
                ["bucket", "seeds", "slots", "keep", "size"],
            )

        have: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and keys[a] != now:
                    yield table(now, have)
                    have = []
                now = int(keys[a])
                have.append(batch.slice(a, b - a))
        if have:
            yield table(now, have)

    return dealt.mapInArrow(run, "bucket int, seeds binary, slots binary, keep binary, size binary")


#: Stands for a missing doc_id inside the index.
NO_ID = -(1 << 63)


def lookup(docs: DataFrame, index: DataFrame, buckets: int, hot: DataFrame) -> DataFrame:
    """doc_id, digest, keep, size for every row of ``docs``; keep and size are null for nonmembers.

    ``hot``: digests with the number of copies (``spread``) of their bucket that their
    lookups are dealt over. Tables and lookups of a bucket meet in a sorted stream: the
    table comes first, then its lookups pass by, however many.
    """
    spread = docs.join(F.broadcast(hot), "digest", "left").withColumn("bucket", _bucket(buckets))
    asked = spread.select("bucket", F.when(F.col("spread").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "spread")).cast("int").alias("copy"), F.lit(1).alias("kind"), "doc_id", "digest", *[F.lit(None).cast("binary").alias(c) for c in ("seeds", "slots", "keep", "size")])
    copies = hot.withColumn("bucket", _bucket(buckets)).groupBy("bucket").agg(F.max("spread").alias("spread"))
    tables = index.join(F.broadcast(copies), "bucket", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)).cast("int") - 1)))
    tables = tables.select("bucket", "copy", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "seeds", "slots", "keep", "size")
    both = tables.unionByName(asked).repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, slots, keep, size = None, None, None, None, None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            key = batch.column("bucket").to_numpy().astype(np.int64) << 32 | batch.column("copy").to_numpy()
            cuts = sorted({0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), *(np.flatnonzero(kind == 0) + 1).tolist(), *np.flatnonzero(kind == 0).tolist(), len(key)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if kind[a] == 0:
                    row = {c: batch.column(c)[a].as_py() for c in ("seeds", "slots", "keep", "size")}
                    slots = np.frombuffer(row["slots"], np.uint8).reshape(-1, DIGEST)
                    h = PerfectHash(np.frombuffer(row["seeds"], np.int64), len(slots))
                    keep, size, at = np.frombuffer(row["keep"], np.int64), np.frombuffer(row["size"], np.int64), key[a]
                    continue
                part = batch.slice(a, b - a)
                if at == key[a]:
                    d = np.frombuffer(b"".join(part.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
                    s = h.slots(d)
                    miss = ~(slots[s] == d).all(axis=1)
                    k, n = pa.array(keep[s], mask=miss | (keep[s] == NO_ID)), pa.array(size[s], mask=miss)
                else:
                    k = n = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), k, n], ["doc_id", "digest", "keep", "size"])

    return both.mapInArrow(run, "doc_id long, digest binary, keep long, size long")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs``.

    ``history`` (doc_id, digest) is what earlier runs kept; without it the table's own
    distinct digests are the history. A group's winner is the row with the largest doc_id;
    rows that share it all stay. With a history, its winner stands and the new rows of
    the group go. Null texts are empty texts; rows without doc_id take part and lose against
    any other; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.save(digests(docs), "digests")
    past = rows if history is None else history
    distinct = scratch.save(past.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size")), "distinct")
    n, total = distinct.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, -(-n // BUCKET))
    index = scratch.save(build_index(distinct, buckets), "index")
    # At most 1 / HOT_SHARE digests can each hold more than that share of the rows looked up.
    counts = distinct if history is None else rows.groupBy("digest").agg(F.count("*").alias("size"))
    many = total if history is None else rows.count()
    unit = max(1.0, (many or 0) * HOT_SHARE)
    hot = counts.where(F.col("size") > unit).select("digest", F.ceil(F.col("size") / unit).cast("int").alias("spread"))
    found = scratch.save(lookup(rows, index, buckets, hot), "found")
    members = found.where("size IS NOT NULL")
    if history is None:
        members = members.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep")))
    else:
        members = members.withColumn("kept", F.lit(False))
    strangers = found.where("size IS NULL").drop("keep", "size")
    groups = strangers.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
    others = strangers.join(groups, "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep"))).select(members.columns)
    return members.unionByName(others).select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", "digest")
