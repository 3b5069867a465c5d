"""Links between similar items through shared keys, without all pairs of a group.

Items post themselves under keys such that two similar items share one. Items under one key
form a list. A first round links each list by a spanning forest of the pairs that pass a
cheap filter, at most one candidate an item; the candidates are verified on the items' full
contents and give components. A second round returns to the lists where a filtered pair was
left out, and verifies only pairs that still lie in different components, so groups of
copies cost a multiple of their size, yet no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, released, sliced

#: Members of a list that are held at once; longer lists are taken in such pieces.
PIECE = 2048
#: Bytes of first contents that are verified at once.
VERIFIED = 2 << 20
#: Lists up to this length get all their pairs tested, many lists side by side.
SHORT = 1024
#: Lists up to this length are tested step by step, all together; longer ones each by itself.
BESIDE = 48

#: ok(payload of one or more items, payload of others) -> which pairs pass; payloads are two integer arrays.
PairFilter = Callable[[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], np.ndarray]


#: Edges that one task takes at once; with so few left, more rounds over all partitions would only cost their start.
FINISH = 10_000


def _finish(edges: DataFrame) -> DataFrame:
    """(id, to) of at most FINISH edges, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(a: int) -> int:
            up.setdefault(a, a)
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            return a

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(a) for a in up], pa.int64())], ["id", "to"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "id long, to long")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b): one root a component.

    Contraction: each node moves to the least of itself and its neighbours, edges follow, and
    what remains is contracted again. From the third round on a fresh hash orders the nodes,
    so that the number of rounds is logarithmic whatever the numbering. Each round is one
    aggregation and two joins over a shrinking table; the last FINISH edges are one task's.
    """
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    turn = 0
    while left := e.count():
        if left <= FINISH:
            maps.append(scratch.save(_finish(e), "moves"))
            break

        def rank(c: str, turn=turn):
            return F.struct((F.xxhash64(F.lit(turn), c) if turn > 1 else F.lit(0).cast("long")).alias("order"), F.col(c).alias("id"))

        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = scratch.save(least.select(F.col("a").alias("id"), F.when(F.col("m") < rank("a"), F.col("m")["id"]).otherwise(F.col("a")).alias("to")), "moves")
        maps.append(move)
        nxt = e.join(move.withColumnsRenamed({"id": "a", "to": "x"}), "a").join(move.withColumnsRenamed({"id": "b", "to": "y"}), "b")
        nxt = nxt.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, e = e, scratch.save(nxt, "edges")
        scratch.drop(old)
        turn += 1
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[0].withColumnRenamed("to", "root")
    for move in maps[1:]:
        step = move.withColumnsRenamed({"id": "root", "to": "next"})
        out = out.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return scratch.save(out, "components") if len(maps) > 1 else out


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of consecutive rows and the starts of runs of equal keys; runs over PIECE rows come in pieces."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if rest is not None:
            now = {n: np.concatenate((rest[n], v)) for n, v in now.items()}
        size = len(next(iter(now.values())))
        if not size:
            continue
        new = np.zeros(size, bool)
        new[0] = True
        for k in keys:
            new[1:] |= now[k][1:] != now[k][:-1]
        start = np.flatnonzero(new)
        last = int(start[-1])
        if size - last >= PIECE:
            rest = None
            yield now, start
        else:
            rest = {n: v[last:] for n, v in now.items()}
            if last:
                yield {n: v[:last] for n, v in now.items()}, start[:-1]
    if rest is not None and len(next(iter(rest.values()))):
        size = len(next(iter(rest.values())))
        new = np.zeros(size, bool)
        new[0] = True
        for k in keys:
            new[1:] |= rest[k][1:] != rest[k][:-1]
        yield rest, np.flatnonzero(new)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Numbers of the pairs that join trees."""
    up = list(range(n))
    out = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(k)
    return out


def _passing(key_start: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray, ok: PairFilter) -> tuple[np.ndarray, np.ndarray]:
    """All passing pairs inside many short lists at once: every place against the one d further on, for growing d."""
    of = np.repeat(np.arange(len(size)), size)
    at = np.repeat(key_start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(of))
    end = (key_start + size)[of]
    left, right = [], []
    d = 1
    while len(at):
        on = at + d < end
        at, end = at[on], end[on]
        if not len(at):
            break
        good = ok((p[at], q[at]), (p[at + d], q[at + d]))
        left.append(at[good])
        right.append(at[good] + d)
        d += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _passing_in(start: int, size: int, p: np.ndarray, q: np.ndarray, ok: PairFilter) -> tuple[np.ndarray, np.ndarray]:
    """All passing pairs inside one list, many of its members at once."""
    left, right = [], []
    on = np.arange(start, start + size)
    rows = max(1, TESTED // size)
    for at in range(0, size, rows):
        i, j = np.nonzero(on[at : at + rows, None] < on)
        i, j = on[i + at], on[j]
        good = ok((p[i], q[i]), (p[j], q[j]))
        left.append(i[good])
        right.append(j[good])
    return np.concatenate(left), np.concatenate(right)


def _first_links(ids: np.ndarray, p: np.ndarray, q: np.ndarray, ok: PairFilter) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """Spanning pairs of one long list, leader by leader, and whether a filtered pair may be left out."""
    out, left, rest = [], False, np.arange(len(ids))
    while len(rest) > 1:
        lead, others = rest[0], rest[1:]
        good = ok((p[lead], q[lead]), (p[others], q[others]))
        if good.any():
            hit = others[good]
            out.append((np.full(len(hit), ids[lead]), ids[hit]))
            left = True
        rest = others[~good]
    return out, left


LISTED = "kind int, key long, id long, p long, q long"


def first_round(postings: DataFrame, ok: PairFilter) -> DataFrame:
    """From (key, id, p, q): kind 0 candidates (key and id are the pair), kind 1 the postings of lists to come back to."""
    dealt = postings.select("key", "id", "p", "q").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # first member of the list that the last pieces were part of
        for now, start in _runs(batches, ("key",)):
            key, ids, p, q = now["key"], now["id"], now["p"], now["q"]
            size = np.diff(np.concatenate((start, [len(key)])))
            # Spark sorts by one number much faster than by three; most keys have one posting.
            shared = np.flatnonzero(np.repeat(size > 1, size))
            if len(shared):
                order = shared[np.lexsort((ids[shared], q[shared], key[shared]))]
                ids, p, q = ids.copy(), p.copy(), q.copy()
                ids[shared], p[shared], q[shared] = ids[order], p[order], q[order]
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            back: list[np.ndarray] = []
            # A list that began in an earlier stretch goes on here.
            goes_on = np.zeros(len(start), bool)
            goes_on[0] = carried is not None and carried[0] == key[0]
            short = (size > 1) & (size <= SHORT) & ~goes_on
            if short.any():
                few, more = short & (size <= BESIDE), short & (size > BESIDE)
                found = [_passing(start[few], size[few], p, q, ok), *(_passing_in(s, n, p, q, ok) for s, n in zip(start[more].tolist(), size[more].tolist(), strict=True))]
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                # Neighbours first.
                order = np.argsort(j - i, kind="stable")
                i, j = i[order], j[order]
                differ = ids[i] != ids[j]
                i, j = i[differ], j[differ]
                if len(i):
                    places, at = np.unique(np.concatenate((i, j)), return_inverse=True)
                    keep = _forest(at[: len(i)], at[len(i) :], len(places))
                    pairs.append((ids[i[keep]], ids[j[keep]]))
                    # Pairs beyond the forest are for later, with the members that they concern.
                    spare = np.ones(len(i), bool)
                    spare[keep] = False
                    if spare.any():
                        run = np.searchsorted(start, i, "right")
                        again_in = np.isin(run, run[spare])
                        back.append(np.unique(np.concatenate((i[again_in], j[again_in]))))
            many = (size > SHORT) | goes_on
            for s, n in zip(start[many].tolist(), size[many].tolist(), strict=True):
                for at in range(s, s + n, PIECE):
                    on = np.arange(at, min(at + PIECE, s + n))
                    _, one = np.unique(ids[on], return_index=True)
                    on = on[np.sort(one)]
                    links, left = _first_links(ids[on], p[on], q[on], ok)
                    pairs += links
                    again = carried is not None and carried[0] == key[s]
                    if again:
                        _, lead, lp, lq = carried
                        good = ok((lp, lq), (p[on], q[on]))
                        pairs.append((np.full(int(good.sum()), lead), ids[on[good]]))
                    elif n >= PIECE:
                        carried = (key[s], ids[on[0]], p[on[0]], q[on[0]])
                    if left or again or n >= PIECE:
                        back.append(on)
            if pairs and sum(len(a) for a, _ in pairs):
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                on = lo != hi
                both = np.unique(np.stack((lo[on], hi[on]), 1), axis=0)
                zero = np.zeros(len(both), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(both), np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(zero), pa.array(zero)], ["kind", "key", "id", "p", "q"])
            if back:
                on = np.concatenate(back)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(on), np.int32)), pa.array(key[on]), pa.array(ids[on]), pa.array(p[on]), pa.array(q[on])], ["kind", "key", "id", "p", "q"])

    return dealt.mapInArrow(released(run), LISTED)


def second_round(back: DataFrame, components: DataFrame, ok: PairFilter, marks: DataFrame | None = None, may: Callable[[bytes, bytes], bool] | None = None) -> DataFrame:
    """Pairs (a, b) of the lists in ``back`` that pass the filter and lie in different components.

    With ``marks`` (id, content) a pair also has to pass ``may`` on the two small contents. A
    list of over PIECE members is dealt out as pairs of blocks, each pair a group of its own.
    """
    named = back.join(components, "id", "left").select("key", "id", "p", "q", F.coalesce("root", "id").alias("root"))
    if marks is not None:
        named = named.join(marks.withColumnRenamed("content", "mark"), "id")
    else:
        named = named.withColumn("mark", F.lit(None).cast("binary"))
    lists = named.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    blocks = F.ceil(F.col("n") / PIECE).cast("int")
    split = named.join(lists.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "p", "q", "root", "mark")
    dealt = split.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "own", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, (x, y) in _groups(batches):
            ids, p, q, root, own, marks_of = t["id"], t["p"], t["q"], t["root"], t["own"], t["mark"]
            a_side = np.flatnonzero(own == x)
            b_side = np.flatnonzero(own == y)
            out = []
            for i in a_side.tolist():
                others = b_side[b_side > i] if x == y else b_side
                others = others[root[others] != root[i]]
                if len(others):
                    good = others[ok((p[i], q[i]), (p[others], q[others]))]
                    if may is not None and len(good):
                        good = good[[may(marks_of[i], marks_of[k]) for k in good.tolist()]]
                    if len(good):
                        out.append(np.stack((np.full(len(good), ids[i]), ids[good]), 1))
            if out:
                both = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])

    return dealt.mapInArrow(released(run), "a long, b long").distinct()


#: Members of a block of a list whose contents meet in one task, pairs of one block that wait to be verified, and pairs and
#: bytes of contents of many blocks that are verified side by side.
BLOCK, PAIRS, MANY, HELD = 2048, 2048, 16_384, 16 << 20
#: Pairs of one block that are filtered at once.
TESTED = 1 << 15

#: (make(contents): a row of numbers for each, may(rows, rows): which pairs can be similar).
Sketch = tuple[Callable[[list[bytes]], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]


class _Block:
    """Members of a block, and the numbers of their components as they are joined."""

    __slots__ = ("ids", "comp", "content")

    def __init__(self, ids: np.ndarray, comp: np.ndarray, content: np.ndarray):
        self.ids, self.comp, self.content = ids, comp, content


def links_inside(back: DataFrame, components: DataFrame, ok: PairFilter, contents: Callable[[DataFrame, int], DataFrame], same: Callable[[list[bytes], list[bytes]], np.ndarray], kind: Column, scratch: Scratch, sketch: Sketch | None = None, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame | None:
    """Links (a, b) that join different components inside the lists of ``back``, None where no list holds two.

    Contents go to the lists, and pairs are verified where they meet: a pair that is no link
    leaves no row, and pairs whose components have been joined on the way are left out, so a
    block gives fewer links than it has members. Pairs of many small blocks are verified side
    by side, since most blocks have too few for that. A pair with several lists in common is
    verified in one of them, which its ids choose, so that no list gets all pairs of a group;
    ``kind`` tells apart postings whose filters may differ. ``sketch`` refuses pairs before they
    wait: rows of numbers made of a batch's contents at once, and two of them compared. Where a
    list's own ``q`` decide too, ``fits`` says so, and a pair needs one list in which they do.
    """
    named = back.join(components, "id", "left").select("key", "id", "p", "q", kind.alias("kind"), F.coalesce("root", "id").alias("root"))
    lists = named.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    mixed = scratch.save(named.join(lists.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key"), "mixed")
    ids = scratch.save(mixed.select("id").distinct(), "ids")
    count = ids.count()
    if not count:
        return None
    # As many keys as an item posts under at most.
    keys = mixed.groupBy("id", "kind").agg(F.array_sort(F.collect_set(F.struct("key", "q"))).alias("at")).select("id", "kind", F.col("at.key").alias("keys"), F.col("at.q").alias("qs"))
    known = scratch.save(keys.join(contents(ids, count), "id"), "known")
    split = mixed.join(known, ["id", "kind"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "p", "q", "root", "keys", "qs", "content")
    dealt = split.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "own", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[_Block, int, int]] = []
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal size
            some = [(t, i, j) for t, i, j in waiting if t.comp[i] != t.comp[j]]
            waiting.clear()
            size = 0
            good = same([t.content[i] for t, i, _ in some], [t.content[j] for t, _, j in some])
            links = []
            for (t, i, j), linked in zip(some, good, strict=True):
                if linked and t.comp[i] != t.comp[j]:
                    links.append((t.ids[i], t.ids[j]))
                    t.comp[t.comp == t.comp[j]] = t.comp[i]
            if links:
                both = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])

        def sketched(now: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            return now | {"sketch": sketch[0](now["content"].tolist())}

        for t, (x, y) in _groups(batches, sketched if sketch else None):
            ids, p, q, own, content, key = t["id"], t["p"], t["q"], t["own"], t["content"], int(t["key"][0])
            comp = np.unique(t["root"], return_inverse=True)[1]
            if not comp.any():
                continue
            block = _Block(ids, comp, content)
            keys: dict[int, dict[int, int]] = {}

            def keys_at(i: int, keys=keys, lists=t["keys"], qs=t["qs"]) -> dict[int, int]:
                if i not in keys:
                    keys[i] = dict(zip(lists[i].tolist(), qs[i].tolist(), strict=True))
                return keys[i]

            here = 0
            a_side, b_side = np.flatnonzero(own == x), np.flatnonzero(own == y)
            rows = max(1, TESTED // max(1, len(b_side)))
            for at in range(0, len(a_side), rows):
                some = a_side[at : at + rows]
                apart = comp[some][:, None] != comp[b_side]
                if x == y:
                    apart &= some[:, None] < b_side
                i, j = np.nonzero(apart)
                i, j = some[i], b_side[j]
                near = ok((p[i], q[i]), (p[j], q[j]))
                i, j = i[near], j[near]
                if sketch and len(i):
                    near = sketch[1](t["sketch"][i], t["sketch"][j])
                    i, j = i[near], j[near]
                own: list[tuple[int, int]] = []
                first, left, right = [], [], []
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    here_a, here_b = keys_at(a), keys_at(b)
                    common = here_a.keys() & here_b.keys()
                    if len(common) == 1 or sorted(common)[int(ids[a] ^ ids[b]) % len(common)] == key:
                        own.append((a, b))
                        first.append(len(left))
                        left += [here_a[k] for k in common]
                        right += [here_b[k] for k in common]
                if fits and own:
                    fitting = np.logical_or.reduceat(fits(np.array(left, np.int64), np.array(right, np.int64)), first)
                    own = [own[k] for k in np.flatnonzero(fitting).tolist()]
                for a, b in own:
                    if comp[a] == comp[b]:
                        continue
                    waiting.append((block, a, b))
                    here += 1
                    size += len(content[a]) + len(content[b])
                    if here >= PAIRS or len(waiting) >= MANY or size >= HELD:
                        yield from settle()
                        here = 0
        yield from settle()

    return scratch.save(dealt.mapInArrow(released(run), "a long, b long").distinct(), "links")


def _groups(batches: Iterator[pa.RecordBatch], more: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None) -> Iterator[tuple[dict[str, np.ndarray], tuple[int, int]]]:
    """Whole groups of (key, x, y); blocks bound their size to about twice PIECE. ``more`` adds columns to a batch."""
    rest: dict[str, np.ndarray] | None = None

    def whole(now: dict[str, np.ndarray], last: bool):
        size = len(now["key"])
        new = np.zeros(size, bool)
        new[0] = True
        for k in ("key", "x", "y"):
            new[1:] |= now[k][1:] != now[k][:-1]
        at = [*np.flatnonzero(new).tolist(), size]
        for s, e in zip(at, at[1:] if last else at[1:-1], strict=False):
            yield {n: v[s:e] for n, v in now.items()}, (int(now["x"][s]), int(now["y"][s]))
        return None if last else {n: v[at[-2] :] for n, v in now.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if more is not None:
            now = more(now)
        if rest is not None:
            now = {n: np.concatenate((rest[n], v)) for n, v in now.items()}
        rest = yield from whole(now, False)
    if rest is not None and len(rest["key"]):
        yield from whole(rest, True)


class Members:
    """Bit set of hashed ids of fixed size; a member is always found, others hardly ever. Sizes up to ``MOST`` bytes."""

    MOST = 4 << 20

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, ids: np.ndarray) -> np.ndarray:
        h = mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0


def members(ids: DataFrame, n: int) -> Members:
    """The bit set of column ``id``, put together on the executors and of at most ``Members.MOST`` bytes."""
    size = int(min(Members.MOST, max(1 << 10, 1 << (4 * max(n, 1)).bit_length())))
    part = min(size, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            h = mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(size * 8 - 1)
            np.bitwise_or.at(bits, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        on = [k for k in range(0, size, part) if bits[k : k + part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array([bits[k : k + part].tobytes() for k in on], pa.binary())], ["at", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(b, np.uint8)
                have[at] = have[at] | own if at in have else own
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array([v.tobytes() for v in have.values()], pa.binary())], ["at", "bits"])

    bits = np.zeros(size, np.uint8)
    rows = ids.select(F.col("id").cast("long")).where("id IS NOT NULL").mapInArrow(run, "at long, bits binary").repartition("at").mapInArrow(merged, "at long, bits binary")
    for at, b in rows.collect():
        bits[at : at + part] |= np.frombuffer(bytes(b), np.uint8)
    return Members(bits)


def verified(pairs: DataFrame, contents: DataFrame, same: Callable[[list[bytes], list[bytes]], np.ndarray], most: int = VERIFIED) -> DataFrame:
    """The pairs (a, b) whose contents (id, content) are similar; pairs of about ``most`` bytes of first contents at once."""
    left = contents.withColumnsRenamed({"id": "a", "content": "content_a"})
    right = contents.withColumnsRenamed({"id": "b", "content": "content_b"})
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "content_a", "content_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, left, right, size = [], [], [], [], 0

        def tested() -> pa.RecordBatch:
            good = pa.array(np.asarray(same(left, right), bool))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], ["a", "b"]).filter(good)

        for batch in batches:
            for some in sliced(batch, 2, most):
                now = some.column(2).to_pylist()
                a.append(some.column(0))
                b.append(some.column(1))
                left += now
                right += some.column(3).to_pylist()
                size += sum(map(len, now))
                if size >= most:
                    yield tested()
                    a, b, left, right, size = [], [], [], [], 0
        if a:
            yield tested()

    return joined.mapInArrow(released(run), "a long, b long")


#: (contents(ids, n): (id, content) for a table of n ids, same(contents, contents): which pairs stay).
Check = tuple[Callable[[DataFrame, int], DataFrame], Callable[[list[bytes], list[bytes]], np.ndarray]]


def components(postings: DataFrame, ok: PairFilter, checks: list[Check], scratch: Scratch, marks: DataFrame | None = None, may: Callable[[bytes, bytes], bool] | None = None, kind: Column | None = None, sketch: Sketch | None = None, near: PairFilter | None = None, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, root) of all items with a link.

    ``postings`` (key, id, p, q): two similar items share a key and pass ``ok`` there.
    Candidates pass through ``checks`` in turn, cheap contents first; the last one decides.
    Where all items have a small content of their own, ``marks`` (id, content), the second
    round asks ``may`` about two of them inside the lists, before it makes a pair. With ``kind``
    and ``sketch`` (see ``links_inside``) it verifies inside the lists. Where ``ok`` asks for more
    than the items' own numbers, ``near`` is what it asks of those and ``fits`` the rest.
    """
    listed = scratch.save(first_round(postings, ok), "listed")
    back = listed.where("kind = 1").drop("kind")

    def check(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs, "candidates")
        for contents, same in checks:
            ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
            n = ids.count()
            if not n:
                return pairs
            held = scratch.save(contents(ids, n), "contents")
            left = scratch.save(verified(pairs, held, same, VERIFIED if kind is None else HELD // 2).distinct(), "links")
            scratch.drop(held, ids, pairs)
            pairs = left
        return pairs

    links = check(listed.where("kind = 0").select(F.col("key").alias("a"), F.col("id").alias("b")).distinct())
    first = connected_components(links, scratch)
    more = check(second_round(back, first, ok, marks, may)) if kind is None else links_inside(back, first, near or ok, *checks[-1], kind, scratch, sketch, fits)
    if more is None or more.isEmpty():
        return first
    name = first.withColumnsRenamed({"id": "a", "root": "x"}), first.withColumnsRenamed({"id": "b", "root": "y"})
    between = more.join(name[0], "a", "left").join(name[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    again = connected_components(between, scratch)
    every = first.unionByName(between.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(first.select("id"), "id", "left_anti").select("id", F.col("id").alias("root")))
    return scratch.save(every.join(again.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")), "components")
