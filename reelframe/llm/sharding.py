"""Shards of near equal bytes by longest-processing-time scheduling; equal texts stay together.

Groups are taken from the largest to the smallest, and each goes to the shard with the least
load so far, the top of a heap. The largest groups, a fixed number of them, are scheduled first
on the driver. The others are dealt by their digest over tasks that schedule side by side:
each starts from its share of the loads so far and takes its own groups from the largest to
the smallest, so that its last groups, the smallest, even out what the others left. With one
task this is the sequential schedule itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach

#: The shards * LARGE largest groups are scheduled on the driver.
LARGE = 512
#: Buckets in which they are looked for.
BUCKETS = 16
#: Groups that one task schedules, about, until there are MOST_TASKS tasks.
GROUPS_A_TASK, MOST_TASKS = 4096, 512
#: Rows of one part in which slots are counted, about.
ROWS_A_PART = 4_000_000


class Loads:
    """Heap of (load, turn, shard): the least loaded shard is on top, of equals the lowest from shard ``first`` on."""

    def __init__(self, start: list[int], first: int = 0):
        self.heap = [(load, (shard - first) % len(start), shard) for shard, load in enumerate(start)]
        heapq.heapify(self.heap)

    def place(self, sizes: Iterable[int]) -> list[int]:
        """Shards of groups in the given order."""
        out, heap = [], self.heap
        for size in sizes:
            load, turn, shard = heap[0]
            heapq.heapreplace(heap, (load + size, turn, shard))
            out.append(shard)
        return out

    def loads(self) -> list[int]:
        return [load for load, _, _ in sorted(self.heap, key=lambda x: x[2])]


def measured(docs: DataFrame, by: str) -> DataFrame:
    """doc_id, size, text_crc32, the digest of the group's name, and a number of its own for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col(by).cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(name, 256)).alias("digest"))
    return out.withColumn("row", F.monotonically_increasing_id())


def schedule(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (digest, bytes, n) with a column shard."""
    spark = groups.sparkSession
    count = groups.count()
    # The largest of each of a few buckets first, so that the driver gets as many rows whatever the number of tasks.
    place = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("digest"), F.lit(BUCKETS))).orderBy(F.desc("bytes"), "digest"))
    largest = groups.withColumn("place", place).where(F.col("place") <= shards * LARGE).drop("place")
    large = largest.orderBy(F.desc("bytes"), "digest").limit(shards * LARGE).collect()
    loads = Loads([0] * shards)
    placed = loads.place(r["bytes"] for r in large)
    first = spark.createDataFrame([(bytes(r["digest"]), r["bytes"], r["n"], s) for r, s in zip(large, placed, strict=True)], "digest binary, bytes long, n long, shard int")

    tasks = int(min(MOST_TASKS, max(1, -(-count // GROUPS_A_TASK))))
    behind = F.lit(False)
    if len(large) == shards * LARGE:
        least = large[-1]
        behind = (F.col("bytes") < least["bytes"]) | ((F.col("bytes") == least["bytes"]) & (F.col("digest") > F.lit(bytearray(least["digest"]))))
    small = groups.where(behind).withColumn("task", F.pmod(F.xxhash64("digest"), F.lit(tasks)).cast("int"))
    share = {r["task"]: r["b"] for r in small.groupBy("task").agg(F.sum("bytes").alias("b")).collect()}
    rest = max(1, sum(share.values()))
    start = {task: [load * own // rest for load in loads.loads()] for task, own in share.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, None
        for batch in batches:
            task = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            shard: list[int] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if task[a] != now:
                        now, heap = task[a], Loads(start[int(task[a])], int(task[a]) % shards)
                    shard += heap.place(batch.column("bytes").slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("bytes"), batch.column("n"), pa.array(shard, pa.int32())], ["digest", "bytes", "n", "shard"])

    dealt = small.repartition(tasks, "task").sortWithinPartitions("task", F.desc("bytes"), "digest")
    return first.unionByName(dealt.mapInArrow(run, first.schema))


def numbered(placed: DataFrame, rows: int, shards: int, scratch: Scratch) -> DataFrame:
    """``placed`` with a column slot: places from 0 within each shard, in ascending order of (doc_id, row).

    Rows are counted within ranges of doc_id, and a range starts where the ones before it end.
    """
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            local = np.empty(len(shard), np.int64)
            for s in range(shards):
                on = np.flatnonzero(shard == s)
                local[on] = seen[s] + np.arange(len(on))
                seen[s] += len(on)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(np.full(len(shard), part, np.int32)), pa.array(local)], ["doc_id", "size", "text_crc32", "shard", "part", "local"])

    ranged = placed.select("doc_id", "row", "size", "text_crc32", "shard").repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    counted = scratch.save(ranged.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, part int, local long"), "counted")
    # One row for each range and shard.
    bases = counted.groupBy("shard", "part").agg(F.count("*").alias("n")).selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS base")
    return counted.join(F.broadcast(bases), ["shard", "part"]).withColumn("slot", F.col("base") + F.col("local"))


def shard_documents(docs: DataFrame, shards: int = 8, by: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1. Rows that are equal in column ``by`` share a shard;
    the law is ``bytes``: shards' sizes are near equal, as far as one group may not be larger
    than a shard should be. Slots run from 0 in each shard in the order of doc_id, rows without
    one first; repeated rows each have their own. Null texts count as empty ones and share
    their group; very long texts count whole; groups of equal size go by their digest, shards
    of equal load by their number. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.save(measured(docs, by), "rows")
    groups = scratch.save(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    placed = scratch.save(schedule(groups, shards), "schedule")
    count = rows.count()
    out = numbered(attach(rows, placed, "digest", "n", count), count, shards, scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql(shards: int = 8) -> str:
    """The sequential schedule, one group a step: what one task makes, so for up to GROUPS_A_TASK groups."""
    zeros = ", ".join(["0::BIGINT"] * shards)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT digest, text, b, row_number() OVER (ORDER BY b DESC, digest) AS i FROM (SELECT digest, any_value(text) AS text, sum(size)::BIGINT AS b FROM d GROUP BY digest)),
s AS (SELECT 0::BIGINT AS i, [{zeros}] AS loads, -1::BIGINT AS shard
      UNION ALL
      SELECT i + 1, list_transform(range({shards}), lambda x: loads[x + 1] + CASE WHEN x = k THEN b ELSE 0 END), k
      FROM (SELECT s.i, s.loads, g.b, list_position(s.loads, list_min(s.loads))::BIGINT - 1 AS k FROM s JOIN g ON g.i = s.i + 1)),
k AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda r, z: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)) AS v FROM range(256) x(i))),
c AS (SELECT i, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc
      FROM k, (SELECT i, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM g))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, s.shard::INTEGER AS shard, row_number() OVER (PARTITION BY s.shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN g USING (digest) JOIN s USING (i) JOIN c USING (i)"""
