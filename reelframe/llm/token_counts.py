"""Token counts by compiled finite-state transducers.

Two deterministic machines read each text once.

* The pre-tokenizer is a machine of eleven states over character classes; its transitions
  carry marks for the cuts that become certain with that character (a cut may be known one
  character late). A buffer is divided into chunks of equal length; each chunk is a map
  from entry state to exit state, computed for all chunks in step; the maps compose under a
  parallel prefix scan, which gives every chunk its entry state, and a second pass writes the
  cuts.
* The byte machine reads the pre-tokens. Its states say which token the byte-pair encoding
  of the bytes so far ends in, at each place where a later token could still begin; its
  transitions carry how many more tokens the longer prefix has. States and transitions are
  compiled when first met. A cut sends every state to the initial one, so all pre-tokens
  run side by side.

A text's count is the sum of what its transitions carry. Texts with special tokens are
divided at them, one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .tokens import BLANK, LETTER, NUMBER, WHITE, Merges, byte_classes

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters of a chunk of the pre-tokenizer's scan.
CHUNK = 64
#: Compiled states of the byte machine that a worker keeps; beyond it the machine starts afresh.
STATES_KEPT = 300_000

# Symbols of the pre-tokenizer.
END, S_OTHER_LETTER, S_ONE, S_R_V, S_E, S_L, S_NUMBER, S_BLANK, S_WHITE, S_MARK, S_OTHER = range(11)
# Its states.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, BLANK_1, WHITE_1, BLANK_N, WHITE_N, MARK, MARK_RV, MARK_L = range(11)
#: Marks on transitions: cut before this character, before the one before it.
HERE, BACK = 1, 2


def pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and symbol."""
    letters = (S_OTHER_LETTER, S_ONE, S_R_V, S_E, S_L)
    begin = {**dict.fromkeys(letters, IN_LETTERS), S_NUMBER: IN_NUMBERS, S_BLANK: BLANK_1, S_WHITE: WHITE_1, S_MARK: MARK, S_OTHER: IN_OTHER}
    go = np.zeros((11, 11), np.uint8)
    out = np.zeros((11, 11), np.uint8)

    def put(state, symbol, to, marks=0):
        go[state, symbol], out[state, symbol] = to, marks

    for state in range(11):
        for symbol, to in begin.items():  # what most states do: end here, begin anew
            put(state, symbol, to, HERE)
    for symbol in letters:
        put(IN_LETTERS, symbol, IN_LETTERS)
        for state in (MARK, MARK_RV, MARK_L):
            put(state, symbol, IN_LETTERS, HERE if state == MARK else BACK)
    put(IN_NUMBERS, S_NUMBER, IN_NUMBERS)
    for symbol in (S_MARK, S_OTHER):
        put(IN_OTHER, symbol, IN_OTHER)
        put(MARK, symbol, IN_OTHER)
    # After a mark that begins a pre-token: 's 't 'm 'd, 're 've, 'll.
    put(MARK, S_ONE, FRESH)
    put(MARK, S_R_V, MARK_RV)
    put(MARK, S_L, MARK_L)
    for state, last in ((MARK_RV, S_E), (MARK_L, S_L)):
        for symbol, to in begin.items():
            if symbol not in letters:
                put(state, symbol, to, HERE | BACK)
        put(state, last, FRESH)
        out[state, END] = BACK
    # White space: a run keeps together but for its last character if something follows.
    for state in (BLANK_1, BLANK_N, WHITE_1, WHITE_N):
        late = BACK if state in (BLANK_N, WHITE_N) else 0
        for symbol, to in begin.items():
            if symbol in (S_BLANK, S_WHITE):
                put(state, symbol, BLANK_N if symbol == S_BLANK else WHITE_N)
            elif state in (BLANK_1, BLANK_N):
                put(state, symbol, IN_OTHER if symbol == S_MARK else to, late)
            else:
                put(state, symbol, to, HERE | late)
    return go, out


GO, OUT = pretokenizer()


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    by_class = np.zeros(6, np.uint8)
    by_class[[LETTER, NUMBER, BLANK, WHITE, 5]] = (S_OTHER_LETTER, S_NUMBER, S_BLANK, S_WHITE, S_OTHER)
    ascii_own = np.zeros(256, np.uint8)
    for chars, s in ((b"stmd", S_ONE), (b"rv", S_R_V), (b"e", S_E), (b"l", S_L), (b"'", S_MARK)):
        ascii_own[list(chars)] = s
    return by_class, ascii_own


_BY_CLASS, _OWN = _symbols()


def cuts(symbols: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each position of ``symbols`` (a whole buffer; END stands between texts)."""
    n = len(symbols)
    chunks = -(-(n + 1) // CHUNK)
    grid = np.zeros(chunks * CHUNK, np.uint8)
    grid[:n] = symbols
    steps = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    go, out = GO.ravel(), OUT.ravel()
    # Each chunk as a map of all states, in step.
    maps = np.broadcast_to(np.arange(11, dtype=np.uint8), (chunks, 11)).copy()
    for s in steps:
        maps = go[maps * np.uint8(11) + s[:, None]]
    # Prefix scan by doubling: maps[i] becomes the map of chunks 0..i.
    step = 1
    while step < chunks:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.concatenate((np.zeros(1, np.uint8), maps[:-1, FRESH]))
    marks = np.empty((CHUNK, chunks), np.uint8)
    for k, s in enumerate(steps):
        at = state * np.uint8(11) + s
        marks[k] = out[at]
        state = go[at]
    flat = marks.T.ravel()
    found = (flat[:n] & HERE) > 0
    found |= (flat[1 : n + 1] & BACK) > 0
    return found


class ByteMachine:
    """Byte-pair encoding as a transducer that is compiled as it is used."""

    def __init__(self, merges: Merges):
        import tiktoken

        self.core = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=merges.ranks, special_tokens={})._core_bpe
        self.bytes_of = {r: t for t, r in merges.ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        top = 0
        for token, rank in merges.ranks.items():
            at = 0
            for b in token:
                key = at << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    top += 1
                    nxt = self.child[key] = top
                at = nxt
            self.token_at[at] = rank
        self.open = {key >> 8 for key in self.child}  # nodes that can still grow
        self.fits: dict[tuple[int, int], bool] = {}
        self.column = np.full(256, -1, np.int64)
        self.bytes = [0] * 256
        self.reset()

    def reset(self) -> None:
        self.keys: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.go = np.full((1 << 12, 64), -1, np.int32)
        self.more = np.zeros((1 << 12, 64), np.int8)
        self.column[:] = -1
        self.used = 0

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table's column of each byte; bytes get columns as they are met."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = self.used
                self.bytes[self.used] = b
                self.used += 1
        while self.used > self.go.shape[1]:
            self.go = np.concatenate((self.go, np.full_like(self.go, -1)), axis=1)
            self.more = np.concatenate((self.more, np.zeros_like(self.more)), axis=1)
        return self.column[data]

    def _fits(self, a: int, b: int) -> bool:
        """Whether the encoding of token a followed by token b is just these two."""
        if a < 0:
            return True
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self.core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def compile(self, state: int, column: int) -> None:
        """Add the transition. A state lists for each open place (trie node of the bytes since, token that ends there, tokens since)."""
        kept, last, count = [], -1, 0
        byte = self.bytes[column]
        for node, token, behind in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            if nxt in self.open:
                kept.append((nxt, token, behind))
            if last < 0:
                own = self.token_at.get(nxt, -1)
                if own >= 0 and self._fits(token, own):
                    last, count = own, 1 - behind
        key = (*((n, t, b + count) for n, t, b in kept), (0, last, 0))
        to = self.keys.get(key)
        if to is None:
            to = self.keys[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.go):
                self.go = np.concatenate((self.go, np.full_like(self.go, -1)))
                self.more = np.concatenate((self.more, np.zeros_like(self.more)))
        self.go[state, column] = to
        self.more[state, column] = count

    def run(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each run of ``size`` bytes at ``at``; all runs advance together."""
        if len(self.states) > STATES_KEPT:
            self.reset()
        columns = self._columns(data)
        width = self.go.shape[1]
        order = np.argsort(-size, kind="stable")
        where, length = at[order], size[order]
        total = np.zeros(len(at), np.int32)
        state = np.zeros(len(at), np.int32)
        live = len(at)
        k = 0
        while live:
            live = int(np.searchsorted(-length, -k, "left"))
            if not live:
                break
            key = state[:live].astype(np.int64) * width + columns[where[:live] + k]
            nxt = self.go.ravel()[key]
            if (gap := nxt < 0).any():
                for x in np.unique(key[gap]).tolist():
                    self.compile(*divmod(x, width))
                nxt = self.go.ravel()[key]
            total[:live] += self.more.ravel()[key]
            state[:live] = nxt
            k += 1
        out = np.empty_like(total)
        out[order] = total
        return out


class Counter:
    """Both machines of one tokenizers JSON file."""

    _made: dict[str, "Counter"] = {}

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level files without normalizer are compiled")
        self.machine = ByteMachine(Merges(spec))
        names = [t["content"].encode() for t in spec["added_tokens"]]
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None

    def count(self, batch: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        parts, owner, extra = [], [], np.zeros(len(batch), np.int64)
        for i, t in enumerate(batch):
            if self.special and b"<|" in t and len(own := self.special.split(t)) > 1:
                extra[i] = len(own) - 1
            else:
                own = [t]
            parts += own
            owner += [i] * len(own)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1)
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        cls, width = byte_classes(data)
        symbol = _BY_CLASS[cls]
        own = _OWN[data]
        symbol = np.where(own > 0, own, symbol)
        symbol[ends - 1] = END
        lead = np.flatnonzero(width > 0)
        at = lead[cuts(symbol[lead])]
        if not len(at):
            return extra
        nxt = np.concatenate((at[1:], [len(data)]))
        stop = ends[np.searchsorted(ends, at, "right")] - 1
        n = self.machine.run(data, at, np.minimum(nxt, stop) - at)
        part = np.searchsorted(ends, at, "right")
        return extra + np.bincount(np.array(owner)[part], n, len(batch)).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null and empty texts have 0 bytes and tokens; rows are independent, so repeated rows,
    ties and rows without doc_id each keep their own line, and an empty table gives an empty
    one. Other columns of ``docs`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for batch in batches:
            all_texts = texts(batch.column(1))
            n, at, size = np.zeros(len(all_texts), np.int64), 0, 0
            for i, t in enumerate(all_texts):
                size += len(t)
                if size > 4 << 20 or i == len(all_texts) - 1:
                    n[at : i + 1] = counter.count(all_texts[at : i + 1])
                    at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in all_texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)
