"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

Sets are the distinct word n-grams of documents. For the required overlap o of two sizes a
small set lists all its subsets of o elements, and two small sets that are similar enough
have one in common. A large set goes into the inverted lists of the first elements of its
prefix, rarest first, and its lists are scanned for partners. Where small ends is decided by
the cost of both on the sizes at hand. Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Scratch, buffers, fresh, mix64, released, words
from .linking import Members, components, members

#: Rows of this many elements are counted at once for frequent elements.
COUNT_AT = 1_000_000
#: Elements whose frequency is known to all tasks, at most.
FREQUENT = 1 << 20
#: Sizes that may count as small.
SMALLEST_LARGE = 64
#: Bytes of text whose n-grams are made at once.
STEP = 1 << 20
#: Numbers of sets that a task remembers to have given already.
SEEN = 200_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of each text of a buffer; fewer than n words are one n-gram."""
    h, start, _ = words(LOWER[raw], SPACE)
    bound = np.searchsorted(start, offsets)
    # A separator stands between texts, so no word spans two of them.
    roll = np.zeros(len(h), np.uint64)
    out = []
    for k in range(n):
        part = h[k : len(h) - n + 1 + k] if len(h) >= n else h[:0]
        roll[: len(part)] = mix64(roll[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(roll[a : b - n + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = mix64(np.array([x * np.uint64(0x9E3779B97F4A7C15) + v]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _batches(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of every text of a column, a few megabytes at a time."""
    raw, off = buffers(column)
    at, rows = 0, len(off) - 1
    while at < rows:
        to = min(rows, max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1))
        sizes = np.diff(off[at : to + 1])
        # Room for a blank after every text.
        data = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        place = np.ones(len(data), bool)
        ends = np.cumsum(sizes + 1)
        place[ends - 1] = False
        data[place] = raw[off[at] : off[to]]
        for k, s in enumerate(shingle_sets(data, np.concatenate(([0], ends)), n)):
            yield at + k, s
        at = to


def set_id(s: np.ndarray) -> int:
    """A set's number: a 63-bit digest of its elements, which alike sets share."""
    with np.errstate(over="ignore"):
        x = mix64(np.array([np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(s))], np.uint64))[0]
    return int(x >> np.uint64(1))


class Threshold:
    """Overlaps and prefixes for Jaccard similarity of num / den at least, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least common elements of sets of a and b elements."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, a: int) -> range:
        return range(-(-self.num * a // self.den), self.den * a // self.num + 1)

    def prefix(self, a: int) -> int:
        return a - -(-self.num * a // self.den) + 1

    def subsets(self, a: int, large: int) -> int:
        """Subsets that a set of a elements lists for partners under size ``large``; 0 if it would need to leave out over two elements."""
        total = 0
        for b in self.partners(a):
            if b < large:
                d = a - self.overlap(a, b)
                if d > 2:
                    return 0
                if d >= 0:
                    total += comb(a, d)
        return total

    def boundary(self, sizes: dict[int, int], scanned: float) -> int:
        """Size from which sets count as large: the one of least cost.

        A subset costs one row. An entry of an inverted list costs one row and the
        ``scanned`` others it meets there on average.
        """
        best, where = None, 1
        for large in range(1, SMALLEST_LARGE + 1):
            small = [a for a in range(1, large)]
            if any(not self.subsets(a, large) for a in small):
                break
            cost = sum(sizes.get(a, 0) * self.subsets(a, large) for a in small)
            # Small sets near the boundary also enter the lists, for their large partners.
            cost += sum(c * self.prefix(a) * (1 + scanned) for a, c in sizes.items() if a >= large or self.den * a >= self.num * large)
            if best is None or cost < best:
                best, where = cost, large
        return where

    def filter(self, x, y):
        """Pairs of postings (size, position) that can still reach the overlap; position -1: the key is a whole subset."""
        a, i = x
        b, j = y
        need = self.overlap(a, b)
        fits = (self.num * np.maximum(a, b) <= self.den * np.minimum(a, b))
        reach = 1 + np.minimum(a - i - 1, b - j - 1)
        return fits & ((i < 0) | (j < 0) | (reach >= need))


class Frequent:
    """Frequent elements and their counts; all others count as rare."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.bits[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, s[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == s[maybe]
            out[maybe[hit]] = self.counts[at[hit]]
        return out


ROWS = "kind int, doc_id long, n long, sid long, mark binary"


def measure(docs: DataFrame, n: int) -> DataFrame:
    """Kind 0: doc_id, set size, set number and mark of every row. Kind 1: sid is an element that a task has met n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        have = 0

        def counted() -> pa.RecordBatch:
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            on = count >= 3
            return pa.RecordBatch.from_arrays([pa.array(np.ones(int(on.sum()), np.int32)), pa.nulls(int(on.sum()), pa.int64()), pa.array(count[on].astype(np.int64)), pa.array(keys[on].view(np.int64)), pa.nulls(int(on.sum()), pa.binary())], ["kind", "doc_id", "n", "sid", "mark"])

        for batch in batches:
            size, sid, marks = [], [], []
            for _, s in _batches(batch.column(1), n):
                size.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                marks.append(mark(s) if len(s) else None)
                held.append(s)
                have += len(s)
                if have >= COUNT_AT:
                    yield counted()
                    held, have = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(size), np.int32)), batch.column(0), pa.array(size, pa.int64()), pa.array(sid, pa.int64()), pa.array(marks, pa.binary())], ["kind", "doc_id", "n", "sid", "mark"])
        if held:
            yield counted()

    return docs.mapInArrow(released(run), ROWS)


def _subset_keys(s: np.ndarray, t: Threshold, large: int) -> np.ndarray:
    """Keys of the subsets that a small set lists."""
    a, out = len(s), []
    with np.errstate(over="ignore"):
        h = mix64(s)
        total = np.add.reduce(h)
        for b in t.partners(a):
            if b >= large:
                continue
            d = a - int(t.overlap(a, b))
            if d < 0:
                continue
            if d == 0:
                left = np.zeros(1, np.uint64)
            elif d == 1:
                left = h
            else:
                i, j = np.triu_indices(a, 1)
                left = h[i] + h[j]
            out.append(mix64(total - left + np.uint64((min(a, b) << 32) | max(a, b))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


POSTED = "key long, id long, p long, q long"


def postings(docs: DataFrame, n: int, t: Threshold, large: int, frequent: Frequent) -> DataFrame:
    """(key, id, p = set size, q = position) of every set; a task posts copies of a set once."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen = sent.value, set()
        for batch in batches:
            key, sid, size, pos = [], [], [], []

            def put(k: np.ndarray, i: int, a: int, q: np.ndarray) -> None:
                key.append(k)
                sid.append(np.full(len(k), i))
                size.append(np.full(len(k), a))
                pos.append(q)

            for _, s in _batches(batch.column(0), n):
                a = len(s)
                if not a:
                    continue
                i = set_id(s)
                if i in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(i)
                if a < large:
                    k = _subset_keys(s, t, large)
                    put(k, i, a, np.full(len(k), -1))
                if a >= large or t.den * a >= t.num * large:
                    m = t.prefix(a)
                    count = freq.of(s)
                    first = np.flatnonzero(count == 0)[:m]
                    if len(first) < m:
                        often = np.flatnonzero(count)
                        first = np.concatenate((first, often[np.argsort(count[often], kind="stable")][: m - len(first)]))
                    put(s[first], i, a, np.arange(m))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (sid, size, pos))], ["key", "id", "p", "q"])

    return docs.select("text").mapInArrow(released(run), POSTED)


def mark(s: np.ndarray) -> bytes:
    """A set's size and parity bits: how often, odd or even, its elements fall on each of at least as many places.

    Two sets' bits differ on no more places than the sets differ in elements.
    """
    places = max(256, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return len(s).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(x: bytes, y: bytes) -> tuple[int, int, int]:
    """(size, size, elements that the two sets differ in at least) from two marks; the longer bits are folded onto the shorter's places."""
    if len(x) > len(y):
        x, y = y, x
    u, v, places = int.from_bytes(x[4:], "little"), int.from_bytes(y[4:], "little"), 8 * (len(y) - 4)
    while places > 8 * (len(x) - 4):
        places //= 2
        v = (v >> places) ^ (v & ((1 << places) - 1))
    return int.from_bytes(x[:4], "little"), int.from_bytes(y[:4], "little"), (u ^ v).bit_count()


def contents(docs: DataFrame, n: int, wanted: Members) -> DataFrame:
    """(id, content) of the documents in ``wanted``: set number and elements; a task gives a set once."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            on = sent.value.has(batch.column(0).fill_null(0).to_numpy())
            batch = batch.filter(pa.array(on))
            if not batch.num_rows:
                continue
            got = {}
            for _, s in _batches(batch.column(1), n):
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    got[i] = s.tobytes()
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], ["id", "content"])

    return docs.mapInArrow(released(run), "id long, content binary")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets is at least ``threshold``
    (numerator, denominator); component_id is the smallest doc_id that links reach. Words
    are lower-cased (A-Z) runs of bytes between ASCII white space; a text of fewer than n
    words is one n-gram; null and empty texts have empty sets, which link with nothing and
    are components of their own. Repeated rows are equal sets; rows without doc_id join a
    component without naming it. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    t = Threshold(*threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = scratch.save(measure(docs, n), "measured")
    rows = measured.where("kind = 0").select("doc_id", "n", "sid")
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = max(50, -(-total // FREQUENT))
    # Counts sum to at most the total, so no more than FREQUENT elements reach the limit.
    often = measured.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    frequent = Frequent(often["sid"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64))
    sizes = {r["n"]: r["count"] for r in rows.where(F.col("n").between(1, 2 * SMALLEST_LARGE)).groupBy("n").count().collect()}
    scanned = float((frequent.counts.astype(float) ** 2).sum()) / max(1, total)
    large = t.boundary(sizes, scanned)
    nodes = scratch.save(measured.where("kind = 0 AND sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark")), "nodes")
    marks = nodes.select(F.col("sid").alias("id"), F.col("mark").alias("content"))

    def sets(ids: DataFrame, count: int) -> DataFrame:
        own = ids.join(nodes, ids["id"] == nodes["sid"]).select(F.coalesce(nodes["doc_id"], F.lit(0)).alias("id"))
        return contents(docs, n, members(own, count))

    def may_link(x: bytes, y: bytes) -> bool:
        a, b, apart = differ(x, y)
        return apart <= a + b - 2 * t.overlap(a, b)

    def links(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return len(np.intersect1d(a, b, assume_unique=True)) >= t.overlap(len(a), len(b))

    def each(same):
        return lambda xs, ys: np.fromiter((same(x, y) for x, y in zip(xs, ys, strict=True)), bool, len(xs))

    checks = [(lambda ids, count: marks.join(ids, "id", "left_semi"), each(may_link)), (sets, each(links))]
    linked = components(postings(docs, n, t, large, frequent), t.filter, checks, scratch, marks, may_link)
    rooted = nodes.join(linked, nodes["sid"] == linked["id"], "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(names, "root").select("sid", "component_id")
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component; columns as they were.

    Of rows that share this doc_id all stay, and so do rows without doc_id.
    """
    found = jaccard_components(docs, n, threshold)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    name = fresh("gone", docs.columns)
    return docs.join(gone.withColumnRenamed("doc_id", name), F.col("doc_id").cast("long") == F.col(name), "left_anti")
