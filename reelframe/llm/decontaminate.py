"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of ``width`` consecutive item words. For all windows of one length a
shift table on blocks of two words says how far the scan may jump, a hash of the window's
last block selects the few windows that could end here, and direct comparison of all their
words confirms an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, mix64, release, texts

#: Bytes of benchmark texts that one search table is built from; larger benchmarks are searched in blocks of this size. A table takes about 30 bytes a word beside its vocabulary.
BLOCK_BYTES = 8 << 20
FOUND = "struct<n_words: bigint, hit: array<int>, items: array<bigint>>"

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.translate(_WORDS).split()


#: Spreads a block's two word numbers over the slots.
_SPREAD = 1_000_003


class _Group:
    """Tables for the windows of ``m`` words that begin at ``start`` of ``flat``; ``who`` are their items' places."""

    def __init__(self, flat: np.ndarray, m: int, start: np.ndarray, who: np.ndarray):
        self.m, self.block = m, min(2, m)
        at = start[:, None] + np.arange(m)
        h = np.zeros(len(start), np.uint64)
        for k in range(m):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + flat[start + k].astype(np.uint64))
        order = np.lexsort((who, h))
        h, start, who, at = h[order], start[order], who[order], at[order]
        # Windows alike in all words are one entry with several items.
        new = np.ones(len(start), bool)
        new[1:] = (h[1:] != h[:-1]) | (flat[at[1:]] != flat[at[:-1]]).any(axis=1)
        entry = np.cumsum(new) - 1
        more = np.ones(len(start), bool)
        more[1:] = new[1:] | (who[1:] != who[:-1])
        first, who, entry = start[new], who[more], entry[more]
        slots = 1 << max(8, (4 * m * len(first)).bit_length())
        self.mask = min(slots, 1 << 24) - 1
        # Shift table: how far the scan may go on when a block with this slot ends where it stands.
        shift = np.full(self.mask + 1, min(255, m - self.block + 1), np.uint8)
        for end in range(self.block, m + 1):
            np.minimum.at(shift, self._slot(flat, first + end), min(255, m - end))
        self.shift = shift.tobytes()
        # Buckets: entries by the slot of their last block.
        slot = self._slot(flat, first + m)
        by_slot = np.argsort(slot, kind="stable")
        self.bucket = memoryview(np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=self.mask + 1)))).astype(np.int32))
        self.first = memoryview(first[by_slot].astype(np.int32))
        n_who = np.bincount(entry, minlength=len(first))
        begin = np.cumsum(n_who) - n_who
        self.who_at = memoryview(np.stack((begin[by_slot], (begin + n_who)[by_slot]), 1).astype(np.int32).ravel())
        self.who = who.astype(np.int32)

    def _slot(self, flat: np.ndarray, end: np.ndarray) -> np.ndarray:
        before = flat[end - 2].astype(np.int64) if self.block == 2 else 0
        return (before * _SPREAD + flat[end - 1]) & self.mask


class WuManber:
    """Search tables for the windows of some items, as flat arrays."""

    def __init__(self, items: list[tuple[int, bytes]], width: int = 10):
        self.ids: dict[bytes, int] = {}
        self.items = [item_id for item_id, _ in items]
        own = [[self.ids.setdefault(w, len(self.ids) + 1) for w in split_words(text)] for _, text in items]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((w for x in own for w in x), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        length = np.minimum(size, width)
        self.groups = []
        for m in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero(length == m)
            n = size[at] - m + 1
            start = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            self.groups.append(_Group(flat, m, start, np.repeat(at, n)))
        self.flat = flat.tobytes()

    def nbytes(self) -> int:
        """Bytes of the tables, without the vocabulary."""
        return len(self.flat) + sum(len(g.shift) + g.bucket.nbytes + g.first.nbytes + g.who_at.nbytes + g.who.nbytes for g in self.groups)

    def search(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words of the text, spans of words inside occurrences, items with occurrences; None stands for items without id)."""
        own = split_words(text)
        get = self.ids.get
        seq = np.fromiter((get(w, 0) for w in own), np.int32, len(own))
        n, spans, items = len(seq), [], set()
        if not seq.any():
            return n, spans, items
        known, words, flat = seq.tolist(), seq.tobytes(), self.flat
        blocks = [0, *(seq[:-1].astype(np.int64) * _SPREAD + seq[1:]).tolist()]
        for g in self.groups:
            m, mask, shift, bucket, first = g.m, g.mask, g.shift, g.bucket, g.first
            key = known if g.block == 1 else blocks
            at = m
            while at <= n:
                if not known[at - 1]:  # no window holds this word
                    at += m
                    continue
                slot = key[at - 1] & mask
                step = shift[slot]
                if step:
                    at += step
                    continue
                here = words[4 * (at - m) : 4 * at]
                for k in range(bucket[slot], bucket[slot + 1]):
                    p = 4 * first[k]
                    if flat[p : p + 4 * m] == here:
                        spans.append((at - m, at))
                        items.update(self.items[i] for i in g.who[g.who_at[2 * k] : g.who_at[2 * k + 1]].tolist())
                at += 1
        return n, spans, items


_tables: dict[tuple[int, int], tuple[list, WuManber]] = {}


def _table(items: list[tuple[int, bytes]], width: int) -> WuManber:
    """The tables of a broadcast list, built once a worker process."""
    key = (id(items), width)
    if key not in _tables or _tables[key][0] is not items:
        _tables.clear()
        _tables[key] = (items, WuManber(items, width))
    return _tables[key][1]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Flat, sorted, disjoint starts and ends."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int, nameless: bool) -> Iterator[list[tuple[int, bytes]]]:
    """Benchmark items in groups of bounded size, each small enough to send to every task."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")).toLocalIterator(prefetchPartitions=False)
    have, size = [], 0
    for item_id, text in rows:
        if item_id is None and not nameless:
            continue
        if have and size + len(text) > block_bytes:
            yield have
            have, size = [], 0
        have.append((item_id, bytes(text)))
        size += len(text)
    yield have


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, nameless: bool = False, into: str = "found") -> DataFrame:
    """``docs`` with a last column ``into``, a struct: n_words, hit (flat starts and ends of hit spans, in words), items (sorted ids).

    A benchmark of up to ``block_bytes`` is one table and one pass; a larger one is searched
    block by block, spans and items of a row being carried along. Null and empty texts have no
    words; very long texts are searched whole; items without words match nothing; items without
    id match nothing, or with ``nameless`` are searched as well and count as one item, a null in
    items; repeated items all count, repeated rows are searched each; an empty benchmark hits
    nothing and an empty table gives an empty one. ``into`` must not clash with a column of ``docs``.
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn(into, F.lit(None).cast(FOUND))
    for items in _blocks(benchmark, block_bytes, nameless):
        out = out.withColumn(into, _search(sc.broadcast(items), width)(F.col("text").cast("string"), F.col(into)))
    return out


def _search(sent, width: int):
    """The search as a function of the text and what earlier blocks have found."""

    @F.arrow_udf(FOUND)
    def searched(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = _table(sent.value, width)
        for text, before in columns:
            n_words, hit, found = [], [], []
            for t, old in zip(texts(text), before.to_pylist(), strict=True):
                n, spans, who = table.search(t)
                if old:
                    spans += list(zip(old["hit"][::2], old["hit"][1::2], strict=True))
                    who |= set(old["items"])
                n_words.append(n)
                hit.append(_merge(spans))
                found.append(sorted(who, key=lambda x: (x is None, x or 0)))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], ["n_words", "hit", "items"])
        release()

    return searched


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, nameless: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``; odd rows as in ``find_hits``."""
    found = find_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, width, nameless=nameless).select("doc_id", "found.*")
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit") - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.element_at("hit", i + 2) - F.element_at("hit", i + 1))
    out = found.select("doc_id", "n_words", F.when(F.size("hit") > 0, n_hit).otherwise(0).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, nameless: bool = False) -> DataFrame:
    """The rows of ``docs`` without a hit, columns as they were, whatever their names; odd rows as in ``find_hits``."""
    name = fresh("found", docs.columns)
    return find_hits(docs, benchmark, width, nameless=nameless, into=name).where(F.size(f"{name}.hit") == 0).select(docs.columns)
