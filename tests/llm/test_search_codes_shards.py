"""Sharding, vector codes and ranked search against plain versions of their definitions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelframe.llm import ranked, sharding, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def last(x):
    """Sorts nulls behind everything."""
    return (x is None, x or 0)


# -- sharding ------------------------------------------------------------------------------
def scheduled(rows, shards):
    """Sequential schedule: doc_id, size, crc, shard per row."""
    size = lambda t: len((t or "").encode()) + 1
    groups = defaultdict(int)
    for _, t in rows:
        groups[t or ""] += size(t)
    heap, where = [(0, s) for s in range(shards)], {}
    for t in sorted(groups, key=lambda t: (-groups[t], hashlib.sha256(t.encode()).digest())):
        load, s = heapq.heappop(heap)
        where[t] = s
        heapq.heappush(heap, (load + groups[t], s))
    return sorted(((d, size(t), zlib.crc32((t or "").encode()), where[t or ""]) for d, t in rows), key=lambda r: tuple(map(last, r)))


def test_shards_equal_the_sequential_schedule(docs, nothing, rows):
    out = sharding.shard_documents(docs, 3).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard) for r in out), key=lambda r: tuple(map(last, r))) == scheduled(rows, 3)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    slots = defaultdict(list)
    for r in sorted(out, key=lambda r: r.slot):
        slots[r.shard].append((r.slot, r.doc_id))
    for of in slots.values():
        assert [s for s, _ in of] == list(range(len(of)))
        named = [d for _, d in of if d is not None]
        assert named == sorted(named) and [d for _, d in of][len(of) - len(named) :] == named
    assert sharding.shard_documents(nothing).count() == 0


def test_shards_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_A_TASK", 50)
    monkeypatch.setattr(sharding, "LARGE", 4)
    rnd = random.Random(4)
    texts = [f"{i} " + "x" * min(400, int(rnd.paretovariate(0.8) * 3)) for i in range(700)] + ["copy"] * 300 + [None] * 200
    rnd.shuffle(texts)
    texts.append("long " * 400_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = sharding.shard_documents(df, 8).collect()
    assert len(out) == len(texts)
    where = defaultdict(set)
    loads = Counter()
    groups = Counter()
    for r in out:
        where[texts[r.doc_id] or ""].add(r.shard)
        loads[r.shard] += r["size"]
        groups[texts[r.doc_id] or ""] += r["size"]
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 1
    assert all(len(s) == 1 for s in where.values())
    # The longest text is more than a shard should hold; the others even out among themselves, to less than a text.
    rest = [loads[s] for s in range(8) if s not in where["long " * 400_000]]
    assert max(rest) - min(rest) <= 400
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_shards_by_another_column(spark):
    df = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, host string")
    out = sharding.shard_documents(df, 4, by="host").collect()
    assert len({r.shard for r in out}) == 2 and {r.doc_id % 2: r.shard for r in out} == {r.doc_id % 2: r.shard for r in reversed(out)}


# -- vector codes ----------------------------------------------------------------------------
def plain_codes(rows):
    """(vec_id, code, error, label_error, digest) by the definition, a vector at a time."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**41 for x in v)]
    if not kept:
        return []
    count = Counter(len(v) for _, v, _ in kept)
    length = max(count, key=lambda n: (count[n], n))
    kept = [r for r in kept if len(r[1]) == length]
    width = -(-length // 8)
    cut = lambda v: [(v + [0] * (8 * width - length))[k * width : (k + 1) * width] for k in range(8)]
    parts = [cut(v) for _, v, _ in kept]
    first = sorted(kept, key=lambda r: (last(r[0]), r[1]))[:16]
    books = [[cut(v)[k] for _, v, _ in first] for k in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, book: min(range(len(book)), key=lambda e: (far(p, book[e]), e))
    for _ in range(6):
        for k in range(8):
            own = defaultdict(list)
            for p in parts:
                own[near(p[k], books[k])].append(p[k])
            books[k] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else book for e, book in enumerate(books[k])]
    codes = [[near(p[k], books[k]) for k in range(8)] for p in parts]
    errors = [sum(far(p[k], books[k][c[k]]) for k in range(8)) for p, c in zip(parts, codes, strict=True)]
    errors = [e if e < 2**63 else None for e in errors]
    by_label = defaultdict(list)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label].append(e)
    total = {k: None if None in v or sum(v) >= 2**63 else sum(v) for k, v in by_label.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, bytes(c).hex(), e, total[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=lambda r: tuple(map(last, r)))


def vectors(n, length, spread=1.0, seed=1):
    rnd = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rnd.normal(0, spread, length).astype(np.float32)], [None, 1, 2, 3][i % 4]) for i in range(n)]


odd = [(5, None, 1), (6, [None] * 16, 2), (7, [float("nan")] * 16, None), (8, [float("inf")] + [0.0] * 15, 3), (3, [0.5] * 16, 1), (3, [0.5] * 16, 1), (None, [0.25] * 16, None), (9, [1.0] * 3, 1), (10, [], 1)]


@pytest.mark.parametrize(
    "rows",
    [vectors(60, 16) + odd, vectors(5, 16), vectors(40, 11), vectors(30, 4), [(i, [], 1) for i in range(3)], vectors(30, 16, 1e8), vectors(20, 16, 1e13) + vectors(30, 16), odd[:4], [(i, [float(i % 2)] * 8, None) for i in range(40)]],
)
def test_vector_codes(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, v string, part int").repartition(3)
    got = vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=lambda r: tuple(map(last, r))) == plain_codes(rows)


def test_cells_never_lose_the_nearest_entry():
    rnd = np.random.default_rng(3)
    for scale in (2, 50, 4000):
        for entries in (1, 2, 16):
            book = vector_codes.Codebook(rnd.integers(-scale, scale, (entries, 5)).tolist(), scale)
            parts = rnd.integers(-2 * scale, 2 * scale, (500, 5))
            far = ((parts[:, None, :] - book.entries[None]) ** 2).sum(2)
            lower, upper = book.bounds(parts)
            assert (lower <= far).all() and (far <= upper).all()
            entry, apart = book.nearest(parts)
            assert (entry == far.argmin(1)).all() and (apart == far.min(1)).all()


# -- ranked search ----------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def plain_search(rows, queries, k):
    docs = [(d, w) for d, w in ((d, terms(t)) for d, t in rows) if w]
    count, length = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, q in queries:
        found = []
        for d, w in docs:
            m = 10 + 90 * len(w) * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m)) for t, tf in Counter(w).items() if t in set(terms(q)))
            if score:
                found.append((-score, last(d)))
        out += [(item, i, None if d[0] else d[1], -s) for i, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: tuple(map(last, r)))


QUERIES = [(1, "fox and the DOG"), (1, "fox and the DOG"), (2, None), (3, ""), (4, "!!"), (None, "hello world"), (5, "word word word idiot"), (6, "nobodyhasthis"), (7, "Kelvin 中文 ünïcode don't İstanbul")]


@pytest.mark.parametrize("k", [1, 3, 100])
def test_ranked_search(spark, docs, nothing, rows, k):
    queries = spark.createDataFrame([(i, q, 1, 2) for i, q in QUERIES], "item_id long, text string, query int, rank int")
    got = ranked.search(docs, queries, k).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=lambda r: tuple(map(last, r))) == plain_search(rows, QUERIES, k)
    assert ranked.search(nothing, queries, k).count() == 0 and ranked.search(docs, queries.where("false"), k).count() == 0


def test_search_in_blocks_of_queries_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ranked, "QUERY_BYTES", 30)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(300)] + [(1000, "w1 w2 " * 900_000)]
    queries = [(i, " ".join(rnd.choices(words, k=6))) for i in range(12)]
    got = ranked.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(queries, "item_id long, text string"), 10)
    assert sorted(map(tuple, got.collect()), key=lambda r: tuple(map(last, r))) == plain_search(rows, queries, 10)


def test_treaps_are_search_trees_and_heaps():
    rnd = np.random.default_rng(6)
    for _ in range(30):
        size, docs = int(rnd.integers(1, 6)), int(rnd.integers(1, 40))
        pair = np.unique(rnd.integers(0, size * docs, int(rnd.integers(0, 120))))
        t = ranked.Treaps(pair // docs, pair % docs, rnd.integers(0, 5, len(pair)), size)
        seen = []

        def walk(node, low, high, most):
            if node == t.none:
                return
            assert low < t.doc[node] < high and t.impact[node] <= most
            seen.append(int(node))
            walk(t.left[node], low, t.doc[node], t.impact[node])
            walk(t.right[node], t.doc[node], high, t.impact[node])

        for root in t.root:
            walk(root, -1, docs, 10)
        assert sorted(seen) == list(range(len(pair)))


def test_search_prunes_and_stays_exact():
    rnd = np.random.default_rng(7)
    docs, size = 3000, 40
    at = np.concatenate(([0], np.cumsum(rnd.integers(1, 12, docs))))
    term = np.concatenate([np.sort(rnd.choice(size, b - a, replace=False)) for a, b in zip(at, at[1:], strict=False)])
    impact = (rnd.pareto(1.0, len(term)) * 100).astype(np.int64)
    block = ranked.Block(rnd.permutation(docs), at, term, impact, size)
    looked = 0
    for _ in range(20):
        asked = rnd.choice(size, 4, replace=False)
        best = ranked.Best(10)
        looked += block.search(asked, best)
        whole = np.add.reduceat(np.where(np.isin(term, asked), impact, 0), at[:-1])
        by_id = np.empty(docs, np.int64)
        by_id[block.doc_id] = whole[block.order]
        order = np.lexsort((np.arange(docs), -by_id))[:10]
        assert best.doc_id.tolist() == order.tolist() and best.score.tolist() == by_id[order].tolist()
    assert looked < 20 * docs / 10


def test_queries_by_sql_names(spark, sf_dir):
    from reelframe.llm import registry

    assert registry.op11_sharding(spark, sf_dir).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(registry.op13_ranked_search(spark, sf_dir).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
