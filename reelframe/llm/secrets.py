"""Secret scans with multipart credential linking.

Three base patterns report on their own. Access identifiers, secrets and endpoints that stand
within one scope are joined as intervals: a weak candidate (a user name, a bare high-entropy
word, an endpoint) is reported only where the parts that complete a credential co-occur.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts

#: Order of kinds that begin at the same place.
KINDS = ("assign", "access", "hex", "user", "endpoint", "entropy")
#: Code points on either side of an access identifier that its scope reaches; a blank line ends it sooner.
SCOPE = 200

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
USER = re.compile(r"\b(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})")
ENDPOINT = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+")
WORD = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _scope(text: str, start: int, end: int) -> tuple[int, int]:
    a = text.rfind("\n\n", max(0, start - SCOPE), start)
    b = text.find("\n\n", end, end + SCOPE)
    return (a if a >= 0 else max(0, start - SCOPE)), (b if b >= 0 else end + SCOPE)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Intervals:
    """Spans by start, with the furthest end up to each: finds in one step whether any overlaps a stretch."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans = sorted(spans)
        self.start = [a for a, _, _ in self.spans]
        self.reach = list(accumulate((b for _, b, _ in self.spans), max))
        self.end = sorted(b for _, b, _ in self.spans)

    def overlap(self, lo: int, hi: int) -> bool:
        i = bisect_left(self.start, hi)
        return i > 0 and self.reach[i - 1] > lo

    def beside(self, a: int, b: int, lo: int, hi: int) -> bool:
        """Whether any span reaches into lo..hi and lies wholly outside a..b."""
        i, j = bisect_left(self.start, b), bisect_right(self.end, a)
        return (i < len(self.start) and self.start[i] < hi) or (j > 0 and self.end[j - 1] > lo)


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates that complete a credential within a scope, joined as overlapping intervals.

    An identifier is an access key or a user name, a secret an assignment, a hex run or a
    high-entropy word outside all other spans, an endpoint a URL. Such a word counts beside an
    access key, or beside a user name with an endpoint; a user name or an endpoint counts beside
    a secret that does not overlap it, never beside an identifier alone. Words and URLs are read whole, also across the
    edge of a scope.
    """
    users = [(m.start(), m.end(), "user") for m in USER.finditer(text)] if "=" in text or ":" in text else []
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    access = [s for s in base if s[2] == "access"]
    if not (users or ends or access):
        return []
    words: list[tuple[int, int, str]] = []
    if access or (users and ends):
        covered = Intervals([*base, *users, *ends])
        near_access = Intervals([(*_scope(text, a, b), k) for a, b, k in access])
        beside = Intervals(ends)
        near_user = Intervals([(lo, hi, k) for a, b, k in users for lo, hi in [_scope(text, a, b)] if beside.overlap(lo, hi)])
        for m in WORD.finditer(text):
            a, b = m.span()
            if covered.overlap(a, b) or not (near_access.overlap(a, b) or near_user.overlap(a, b)):
                continue
            w = m.group()
            if entropy(w) >= 3.5 and any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
                words.append((a, b, "entropy"))
    secrets = Intervals([*(s for s in base if s[2] != "access"), *words])
    return [s for s in (*users, *ends) if secrets.beside(s[0], s[1], *_scope(text, s[0], s[1]))] + words


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the base spans, and all spans as kind:start:end (code points).

    Null and empty texts have no spans; very long texts are scanned whole; spans of one start
    stand in the order of kinds; repeated rows are scanned each; rows without doc_id keep their
    row; an empty table gives an empty one. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in texts(batch.column(1)):
                s = t.decode()
                base = base_spans(s)
                more = linked_spans(s, base)
                kinds = Counter(k for *_, k in base)
                own = joined(base)
                out.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(own.encode()).hexdigest(), joined([*base, *more]) if more else own, len(more)))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b for b in batches if b.num_rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(slices, FOUND)
