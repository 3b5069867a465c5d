"""Ranked lexical search with inverted treaps.

Documents are read once for their postings under the queries' terms. Each task builds, block
of documents by block, one treap a term: a binary search tree by document and a heap by
impact, so that a node's impact is the largest of its subtree. A query walks its terms'
treaps together: the roots over an interval of documents bound every score inside it by the
sum of their impacts; an interval whose bound is under the k-th best score so far is cut off,
any other is split at the document of its greatest impact. What a task has found bounds its
later blocks, and the tasks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, buffers, byte_set, mix64, released, sliced, words

#: Everything but letters and digits of ASCII, and bytes of other characters, stands between terms.
BETWEEN = byte_set(bytes(c for c in range(128) if not chr(c).isalnum()))
#: Bytes of query texts that go to the tasks together; more queries take another pass.
QUERY_BYTES = 2 << 20
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1 << 21
#: Treap nodes that one step of a walk holds.
STEP = 1 << 18
#: Stands for a missing doc_id, behind all others.
NO_ID = (1 << 63) - 1


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term with its repeats, row of its text); each text must end in a separator."""
    raw, offsets = buffers(column)
    h, start, _ = words(LOWER[raw], BETWEEN)
    return h, np.searchsorted(offsets, start, "right") - 1


class Queries:
    """Distinct terms of some query texts and, per query, the numbers of its terms."""

    def __init__(self, rows: list[tuple[int, int | None, str]]):
        self.number, self.name = [r[0] for r in rows], [r[1] for r in rows]
        h, row = term_hashes(pa.array([r[2] + "\n" for r in rows], pa.large_string()))
        self.vocabulary, term = np.unique(h, return_inverse=True)
        self.terms = [np.unique(x) for x in np.split(term, np.searchsorted(row, np.arange(1, len(rows))))]


def query_blocks(queries: DataFrame) -> Iterator[Queries]:
    """The rows of ``queries`` (item_id, text) in groups of bounded size."""
    have: list[tuple[int, int | None, str]] = []
    size = at = 0
    for item, text in queries.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).toLocalIterator():
        if have and size + len(text) > QUERY_BYTES:
            yield Queries(have)
            have, size = [], 0
        have.append((at, item, text))
        at, size = at + 1, size + len(text)
    if have:
        yield Queries(have)


def postings(docs: DataFrame, sent) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and counts of those that a query has, for every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value.vocabulary
        size = max(1, len(vocabulary))
        for batch in batches:
            for some in sliced(batch, 1):
                h, row = term_hashes(some.column(1))
                n = np.bincount(row, minlength=some.num_rows)
                place = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                known = vocabulary[place] == h if len(vocabulary) else np.zeros(len(h), bool)
                pair, tf = np.unique(row[known] * size + place[known], return_counts=True)
                at = np.searchsorted(pair // size, np.arange(some.num_rows + 1))
                term, tf = (pair % size).astype("<i4"), tf.astype("<i4")
                on = np.flatnonzero(n)
                lists = [pa.array([x[at[k] : at[k + 1]].tobytes() for k in on.tolist()], pa.binary()) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(on)), pa.array(n[on].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n")).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n long, terms binary, tfs binary")


def statistics(posted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each of ``size`` terms; a task counts before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(df[on])], ["term", "df"])

    documents, length = posted.agg(F.count("*"), F.sum("n")).first()
    out = np.zeros(size, np.int64)
    for term, df in posted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return documents, length or 0, out


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of every term."""
    known, place = np.unique(df, return_inverse=True)
    return np.array([floor(1000 * log((2 * documents + 2) / (2 * d + 1))) for d in known.tolist()], np.int64)[place]


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Contribution of postings to the score; ``n`` is the length of each one's document."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        m = 10 + 90 * n * documents // length
    else:
        m = np.array([10 + 90 * x * documents // length for x in n.tolist()], np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Treaps:
    """One treap for each term of a block of documents, as arrays over the postings in order of (term, document).

    The parent of a posting is the lesser of the nearest greater ones on either side, which
    pointers find that jump over smaller ones. Equal impacts are ordered by a hash of the
    document, so that treaps stay shallow. The last node stands for an empty treap.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, size: int):
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order], impact[order]
        count = len(term)
        rank = impact << np.int64(20) | (mix64(doc.astype(np.uint64) + np.uint64(1)) >> np.uint64(44)).astype(np.int64)
        # Shifted by one: a sentinel greater than all stands on either side.
        high = np.concatenate(([np.iinfo(np.int64).max], rank, [np.iinfo(np.int64).max]))
        cut = np.flatnonzero(np.diff(term)) + 1
        starts, ends = np.concatenate(([0], cut))[: max(1, count)], np.concatenate((cut, [count]))
        before, after = np.arange(count + 2) - 1, np.arange(count + 2) + 1
        if count:
            before[starts + 1], after[ends] = 0, count + 1
        self._jump(before, high, np.less)
        self._jump(after, high, np.less_equal)
        own = np.arange(1, count + 1)
        left, right = high[before[own]], high[after[own]]
        top = (before[own] == 0) & (after[own] == count + 1)
        from_right = (right <= left) & ~top
        from_left = ~from_right & ~top
        none = count
        self.left, self.right = np.full(count + 1, none, np.int32), np.full(count + 1, none, np.int32)
        self.left[after[own[from_right]] - 1] = own[from_right] - 1
        self.right[before[own[from_left]] - 1] = own[from_left] - 1
        self.root = np.full(size, none, np.int32)
        self.root[term[top]] = own[top] - 1
        self.doc, self.impact = np.append(doc, -1).astype(np.int32), np.append(impact, 0)
        self.none = none

    @staticmethod
    def _jump(to: np.ndarray, high: np.ndarray, smaller) -> None:
        on = np.arange(1, len(to) - 1)
        while len(on):
            on = on[smaller(high[to[on]], high[on])]
            to[on] = to[to[on]]

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest node of each treap between the documents ``low`` and ``high`` of its row, at or below ``node``."""
        out = node.ravel().copy()
        low, high = np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
        on = np.arange(len(out))
        while len(on):
            now = out[on]
            doc = self.doc[now]
            back, on_left = (doc >= high[on]) & (now != self.none), (doc <= low[on]) & (now != self.none)
            out[on] = np.where(back, self.left[now], np.where(on_left, self.right[now], now))
            on = on[back | on_left]
        return out.reshape(node.shape)


class Best:
    """The ``k`` highest (score, doc_id) so far, equal scores by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc_id = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A document needs this score at least."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray) -> None:
        on = score >= self.least
        if on.any():
            score, doc_id = np.concatenate((self.score, score[on])), np.concatenate((self.doc_id, doc_id[on]))
            order = np.lexsort((doc_id, -score))[: self.k]
            self.score, self.doc_id = score[order], doc_id[order]


class Block:
    """Documents with their postings; ``search`` adds a query's best documents to a list."""

    def __init__(self, doc_id: np.ndarray, at: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        order = np.argsort(doc_id, kind="stable")
        self.doc_id = doc_id[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.repeat(np.arange(len(doc_id)), np.diff(at))
        self.at, self.order, self.term, self.impact = at, order, term, impact
        self.treaps = Treaps(term, place[owner], impact, size)
        self.asked = np.zeros(size, bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents under the terms that ``asked`` marks."""
        own = self.order[docs]
        start, size = self.at[own], self.at[own + 1] - self.at[own]
        first = np.cumsum(size) - size
        flat = np.arange(int(size.sum())) + np.repeat(start - first, size)
        total = np.concatenate(([0], np.cumsum(np.where(self.asked[self.term[flat]], self.impact[flat], 0))))
        return total[first + size] - total[first]

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Documents looked at."""
        t, looked = self.treaps, 0
        roots = t.root[terms]
        roots = roots[roots != t.none]
        if not len(roots):
            return 0
        self.asked[terms] = True
        rows = max(1, STEP // len(roots))
        waiting = [(roots[None, :], np.array([-1]), np.array([len(self.doc_id)]))]
        while waiting:
            node, low, high = waiting.pop()
            if len(node) > rows:
                waiting.append((node[rows:], low[rows:], high[rows:]))
                node = node[:rows]
            impact = t.impact[node]
            # Equal bounds stay: a lower doc_id wins among equal scores.
            on = np.flatnonzero(impact.sum(axis=1) >= best.least)
            if not len(on):
                continue
            node, low, high = node[on], low[on], high[on]
            pivot = t.doc[node[np.arange(len(on)), impact[on].argmax(axis=1)]]
            best.add(self.scores(pivot), self.doc_id[pivot])
            looked += len(on)
            low, high = np.concatenate((low, pivot)), np.concatenate((pivot, high))
            both = t.within(np.concatenate((node, node)), low, high)
            on = np.flatnonzero(t.impact[both].sum(axis=1) >= best.least)
            if len(on):
                waiting.append((both[on], low[on], high[on]))
        self.asked[terms] = False
        return looked


def blocks(batches: Iterator[pa.RecordBatch], weight: np.ndarray, documents: int, length: int) -> Iterator[Block]:
    """The documents of a task in blocks of bounded size."""
    have: list[tuple[np.ndarray, ...]] = []
    docs = posted = 0

    def made() -> Block:
        doc_id, n, size, term, tf = (np.concatenate(x) for x in zip(*have, strict=True))
        at = np.concatenate(([0], np.cumsum(size)))
        return Block(doc_id, at, term, impacts(weight[term], tf.astype(np.int64), np.repeat(n, size), documents, length), len(weight))

    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            some = batch.slice(k, 1024)
            terms = some.column(2).to_pylist()
            size = np.array([len(x) // 4 for x in terms], np.int64)
            if have and (docs + some.num_rows > BLOCK_DOCS or posted + int(size.sum()) > BLOCK_POSTINGS):
                yield made()
                have, docs, posted = [], 0, 0
            ids = some.column(0).fill_null(NO_ID).to_numpy()
            have.append((ids, some.column(1).to_numpy(), size, np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(some.column(3).to_pylist()), "<i4")))
            docs, posted = docs + some.num_rows, posted + int(size.sum())
    if have:
        yield made()


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of ``docs`` for every row of ``queries`` (item_id, text).

    Terms are runs of ASCII letters and digits and of other than ASCII characters, A-Z
    lower-cased; each counts once in a query. Null and empty texts have none: such a document
    counts nowhere, such a query has no result. Very long texts are read whole. Equal scores
    go by ascending doc_id, rows without one last; repeated rows are documents of their own,
    and repeated queries are answered each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked-search")
    kind = "query long, item_id long, doc_id long, score long"
    found = spark.createDataFrame([], kind)
    for asked in query_blocks(queries):
        sent = spark.sparkContext.broadcast(asked)
        posted = scratch.save(postings(docs, sent), "postings")
        documents, length, df = statistics(posted, len(asked.vocabulary))
        weight = spark.sparkContext.broadcast(weights(documents, df))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, weight=weight, documents=documents, length=length) -> Iterator[pa.RecordBatch]:
            own = sent.value
            best = [Best(k) for _ in own.terms]
            for block in blocks(batches, weight.value, documents, length):
                for terms, b in zip(own.terms, best, strict=True):
                    block.search(terms, b)
            for number, name, b in zip(own.number, own.name, best, strict=True):
                if rows := len(b.score):
                    ids = pa.array(b.doc_id, mask=b.doc_id == NO_ID)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * rows, pa.int64()), pa.array([name] * rows, pa.int64()), ids, pa.array(b.score)], ["query", "item_id", "doc_id", "score"])

        found = found.unionByName(scratch.save(posted.mapInArrow(released(run), kind), "found"))
        scratch.drop(posted)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # Lists of many tasks are merged in two steps, so that no task gets a query's lists of all tasks.
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def oracle_sql(k: int = 10) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({terms}) AS w FROM benchmark),
asked AS (SELECT q, item_id, unnest(w) AS term FROM q),
d AS (SELECT row_number() OVER () AS d, doc_id, {terms} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS len FROM d WHERE len(w) > 0),
p AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs),
i AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len))) AS v FROM p JOIN f USING (term), s),
r AS (SELECT q, item_id, doc_id, sum(v)::BIGINT AS score FROM asked JOIN i USING (term) GROUP BY q, item_id, d, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {k}"""
