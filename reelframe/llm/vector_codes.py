"""Product codes of vectors: each part of a vector becomes the number of the nearest entry of that part's codebook.

The nearest entry is found as in a vector-approximation file: the entries' coordinates are
quantised into a few cells a position; tables of a part's least and greatest squared
distance to each cell, one a position, add up to a lower and an upper bound for every entry;
only entries whose lower bound is not over the least upper bound are refined with integer
distances. Codebooks are few numbers; the vectors stay where Spark has them, and each round
brings back one sum for each part, entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a coordinate's cell.
CELL_BITS = 4
#: Components from here on count as non-finite: scaled integers stay under 2^53, which doubles hold exactly.
TOO_LARGE = float(1 << 41)
#: Vectors whose bounds are made at once.
STEP = 4096


class Codebook:
    """Entries of one part, quantised into cells; ``nearest`` gives the entry and the squared distance of many parts.

    ``largest`` bounds the components of parts and entries. Distances are 64-bit integers where
    it lets them, else Python's.
    """

    def __init__(self, entries: list[list[int]], largest: int):
        width = len(entries[0]) if entries else 0
        self.kind = np.int64 if 4 * PARTS * max(1, width) * largest * largest < 1 << 63 else object
        self.entries = np.array(entries, self.kind).reshape(len(entries), width)
        cells = 1 << CELL_BITS
        self.low, self.high, self.cell = [], [], []
        for at in range(width):
            column = [int(x) for x in self.entries[:, at]]
            least, span = min(column), max(column) - min(column) + 1
            edges = [least + span * k // cells for k in range(cells + 1)]
            self.low.append(np.array(edges[:-1], self.kind))
            self.high.append(np.array([max(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)], self.kind))
            self.cell.append(np.array([max(k for k in range(cells) if edges[k] <= x) for x in column]))

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, (parts, entries)."""
        lower = np.zeros((len(parts), len(self.entries)), self.kind)
        upper = np.zeros_like(lower)
        for at, cell in enumerate(self.cell):
            x = parts[:, at, None]
            below, above = self.low[at] - x, x - self.high[at]
            outside = np.maximum(np.maximum(below, above), 0)
            across = np.maximum(abs(below), abs(above))
            lower += (outside * outside)[:, cell]
            upper += (across * across)[:, cell]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = parts.astype(self.kind)
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        apart = parts[row] - self.entries[entry]
        # Candidates come by row and then by entry, so the first of the least ones has the lowest index.
        exact = (apart * apart).sum(axis=1)
        start = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(exact, start)
        first = np.flatnonzero(exact == least[row])
        chosen = first[np.searchsorted(row[first], np.arange(len(parts)))]
        return entry[chosen], least


def scaled(table: DataFrame) -> DataFrame:
    """vec_id, label and v, floor(4096 * x) of each component, of the usable vectors."""
    x = F.col("embedding").cast("array<double>")
    # isnan and the bound also exclude infinities; a null component makes the test null.
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < TOO_LARGE), F.lit(False)))
    return table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def kept_vectors(table: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The usable vectors of the most common length, the longest of equally common ones, and that length."""
    every = scratch.save(scaled(table), "vectors")
    common = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    length = common["d"] if common else 0
    return every.where(F.size("v") == length), length


def _parts(column: pa.Array, length: int) -> np.ndarray:
    """(vectors, PARTS, components of a part); vectors that don't divide evenly end in zeros."""
    flat = np.asarray(column.flatten(), np.int64).reshape(len(column), length)
    width = -(-length // PARTS)
    out = np.zeros((len(column), PARTS * width), np.int64)
    out[:, :length] = flat
    return out.reshape(len(column), PARTS, width)


def _coded(batches: Iterator[pa.RecordBatch], column: str, length: int, books: list[Codebook]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their parts, entry numbers, squared distances), a bounded number of vectors at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            some = batch.slice(at, STEP)
            parts = _parts(some.column(column), length)
            entry, apart = zip(*(book.nearest(parts[:, k]) for k, book in enumerate(books)), strict=True)
            yield some, parts, np.stack(entry, 1), np.stack(apart, 1)


def _books(entries: list[list[list[int]]], largest: int) -> list[Codebook]:
    return [Codebook(own, largest) for own in entries]


def fit(vectors: DataFrame, length: int) -> list[list[list[int]]]:
    """Entries of each part's codebook after ROUNDS rounds over all ``vectors``."""
    width = -(-length // PARTS)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    start = [[*r["v"], *[0] * (PARTS * width - length)] for r in first]
    entries = [[v[k * width : (k + 1) * width] for v in start] for k in range(PARTS)]
    largest = _largest(vectors)
    for _ in range(ROUNDS if width else 0):

        def sums(batches: Iterator[pa.RecordBatch], entries=entries) -> Iterator[pa.RecordBatch]:
            books, have = _books(entries, largest), len(entries[0])
            # A task's sums stay below 2^63 for as many rows as components of that size allow, then they are handed on.
            most = max(1, (1 << 62) // max(1, largest))
            total, seen, rows = np.zeros((PARTS, have, width), np.int64), np.zeros((PARTS, have), np.int64), 0

            def handed() -> pa.RecordBatch:
                part, entry, at = (x.ravel() for x in np.indices(total.shape))
                return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array([Decimal(int(x)) for x in total.ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(seen.ravel(), width))], ["part", "entry", "at", "total", "n"])

            for some, parts, entry, _ in _coded(batches, "v", length, books):
                if rows and rows + some.num_rows > most:
                    yield handed()
                    total[:], seen[:], rows = 0, 0, 0
                rows += some.num_rows
                for k in range(PARTS):
                    np.add.at(total[k], entry[:, k], parts[:, k])
                    seen[k] += np.bincount(entry[:, k], minlength=have)
            if rows:
                yield handed()

        found = vectors.select("v").mapInArrow(sums, "part int, entry int, at int, total decimal(38,0), n long")
        # PARTS * ENTRIES * width rows.
        for r in found.groupBy("part", "entry", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect():
            if r["n"]:
                entries[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]
    return entries


def _largest(vectors: DataFrame) -> int:
    found = vectors.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: F.greatest(a, F.abs(c))))).first()[0]
    return int(found or 0)


def digest(entries: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for part in entries for entry in part for x in entry).encode()).hexdigest()


def encode(vectors: DataFrame, length: int, entries: list[list[list[int]]]) -> DataFrame:
    """vec_id, label, code, error of every vector; an error that is no 64-bit integer is null."""
    largest = _largest(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries, largest)
        for some, _, entry, apart in _coded(batches, "v", length, books):
            codes = [bytes(x).hex() for x in entry.astype(np.uint8)]
            errors = [e if e < 1 << 63 else None for e in map(int, apart.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(codes), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def vector_codes(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of ``table`` (vec_id, embedding, label).

    Null vectors and those with a null, NaN or infinite component (or one from 2^41 on) are
    left out, and so are vectors whose length is not the most common one. Vectors that don't
    divide into 8 parts end in zeros; empty ones have code 0 everywhere. Fewer than 16 vectors
    give as many entries; equal vec_ids start in the order of their vectors, rows without
    vec_id last; repeated rows are coded each. Errors beyond 64 bits are null, and so is a
    label's sum with one. An empty table gives an empty one.
    """
    scratch = Scratch(table.sparkSession, "vector-codes")
    vectors, length = kept_vectors(table, scratch)
    entries = fit(vectors, length)
    coded = scratch.save(encode(vectors, length, entries), "coded")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when((F.count("error") == F.count("*")) & (wide <= (1 << 63) - 1), wide).cast("long")
    labels = scratch.save(coded.groupBy("label").agg(whole.alias("label_error"), F.count("*").alias("n")), "labels")
    out = attach(coded, labels, "label", "n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same rounds, one common table each: distances of all parts to all entries."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT r, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT r, part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))::BIGINT AS d FROM p JOIN b{k} USING (part)) GROUP BY r, part, x)""")
        if k < ROUNDS:
            ctes.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, e) AS e FROM b{k} LEFT JOIN (
    SELECT part, entry, list(floor_mean ORDER BY pos) AS m FROM (SELECT part, entry, pos, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS floor_mean
        FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS pos FROM a{k}) GROUP BY part, entry, pos) GROUP BY part, entry) USING (part, entry))""")
    return f"""
WITH {", ".join(ctes)},
codes AS (SELECT r, string_agg(lpad(hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM codes JOIN kept USING (r)"""
