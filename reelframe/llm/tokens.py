"""Token ids of whole texts, equal to the ``tokenizers`` library's, at corpus speed.

The library needs about 1 CPU second a MB. Here a buffer of many texts is cut into
pre-tokens by array operations (the rules of the pattern in the JSON file), Arrow's hash
table finds the distinct ones, and only those go through byte-pair merging with the
file's merges, run by tiktoken's core. Texts with special tokens, or that Unicode
normalisation would change, go through the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from .common import by_bytes

#: Distinct pre-tokens whose ids a worker keeps (about 50 MB), and the longest kept; beyond it the table starts afresh.
PIECES_KEPT, PIECE_BYTES = 250_000, 48
#: Texts are taken in slices of at most this many bytes.
SLICE_BYTES = 4 << 20

BREAK, LETTER, NUMBER, BLANK, WHITE, OTHER = range(6)
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []
_unknown: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point for the pre-tokenizer's pattern."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        out[_WHITE] = WHITE
        out[32] = BLANK
        _classes.append(out)
    return _classes[0]


#: No code point below this is unassigned.
_ASSIGNED = re.compile("[\u0378-\U0010ffff]")


def has_unknown(text: str) -> bool:
    """Whether this Python's Unicode tables lack a character; the library's may be newer, so such texts are the library's."""
    if not _ASSIGNED.search(text):
        return False
    if not _unknown:
        _unknown.append(np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000))
    return bool(_unknown[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character that each UTF-8 byte belongs to, length at lead bytes and 0 elsewhere)."""
    table = char_classes()
    cls = table[data]  # right for ASCII
    size = np.ones(len(data), np.int8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size[data >= 0x80] = 0
        first = data[lead]
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        size[lead] = more + 1
        pad = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
        cp = first.astype(np.uint32) & (np.uint32(0x3F) >> more.astype(np.uint32))
        for k in (1, 2, 3):
            on = more >= k
            cp[on] = (cp[on] << np.uint32(6)) | (pad[lead[on] + k] & np.uint32(0x3F))
        c = table[np.minimum(cp, 0x10FFFF)]
        cls[lead] = c
        for k in (1, 2, 3):
            on = more >= k
            cls[lead[on] + k] = c[on]
    return cls, size


def starts(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start of every pre-token, class of its first character).

    ``spaced``: the pattern lets one blank lead a word and keeps white space as tokens of
    its own; otherwise white space falls away and each digit stands alone.
    """
    n = len(data)
    cls, size = byte_classes(data)
    edges = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty(n, np.uint8)
    before[1:] = cls[:-1]
    before[edges] = BREAK
    white = (cls == BLANK) | (cls == WHITE)
    cut = cls != before
    if spaced:
        before_white = (before == BLANK) | (before == WHITE)
        cut &= ~(before == BLANK) | white
        cut &= ~(white & before_white)
        run = np.flatnonzero(white & before_white & (size > 0))
        after = np.full(n + 4, BREAK, np.uint8)
        after[:n] = cls
        ends = offsets[np.searchsorted(offsets, run, "right")]
        follow = run + size[run]
        cut[run[(follow < ends) & ~np.isin(after[follow], (BLANK, WHITE))]] = True
    else:
        cut |= cls == NUMBER
        cut &= ~(white & ((before == BLANK) | (before == WHITE)))
    cut &= size > 0
    cut[edges] = True
    marks = np.flatnonzero((data == 39) & cut)
    if len(marks):
        ends = offsets[np.searchsorted(offsets, marks, "right")]
        pad = np.concatenate((data, np.zeros(3, np.uint8)))
        a, b = pad[marks + 1], pad[marks + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (marks + 1 < ends)
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (marks + 2 < ends)
        for hit, width in ((one, 2), (two, 3)):
            at = marks[hit]
            cut[at + 1] = False
            after_it = (at + width)[at + width < ends[hit]]
            cut[after_it] = True
    at = np.flatnonzero(cut)
    return at, cls[at]


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The file's vocabulary and merges over raw bytes; ``\\xff`` (never in UTF-8) marks a word's end."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        letter, end = _byte_letters(), b"\xff"

        def raw(token: str) -> bytes | None:
            word = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if word else token
            return None if any(c not in letter for c in body) else bytes(letter[c] for c in body) + (end if word else b"")

        self.ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        if self.suffix:
            self.ranks |= {bytes([b]) + end: 256 + b for b in range(255)}
        n = 1 + len(self.ranks)
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if self.ranks.setdefault(raw(a + b), n + i) != n + i:
                raise ValueError("two merges give the same token; the order of merges isn't that of tokens")
        self.ids = np.zeros(n + len(model["merges"]), np.uint32)
        for token, token_id in model["vocab"].items():
            if (at := self.ranks.get(raw(token))) is not None:
                self.ids[at] = token_id


class Encoder:
    """Ids of texts under one tokenizers JSON file; one per worker process and file."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spaced = spec["normalizer"] is None
        merges = Merges(spec)
        self.ids, self.end = merges.ids, b"\xff" if merges.suffix else b""
        self.core = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=merges.ranks, special_tokens={})._core_bpe
        names = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, names)).encode()) if names else None
        self.kept: dict[bytes, list[int]] = {}

    def _odd(self, text: bytes) -> bool:
        """Whether only the library can tell what it makes of a text."""
        if self.special and b"<|" in text and self.special.search(text):
            return True
        if text.isascii():
            return False
        s = text.decode()
        if has_unknown(s):
            return True
        return not self.spaced and self._changed(s)

    @staticmethod
    def _changed(s: str) -> bool:
        """Whether normalisation does more than lower-casing each character."""
        return "Σ" in s or not unicodedata.is_normalized("NFC", s) or not unicodedata.is_normalized("NFC", s.lower())

    def slices(self, batch: list[bytes]):
        sizes = np.fromiter(map(len, batch), np.int64, len(batch))
        for a, b in by_bytes(sizes, SLICE_BYTES):
            yield batch[a:b]

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, start of each text's ids among them: one more than texts)."""
        odd = {i: np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, np.uint32) for i, t in enumerate(batch) if self._odd(t)}
        plain = [b"" if i in odd else t for i, t in enumerate(batch)]
        if not self.spaced:
            plain = [t.lower() if t.isascii() else t.decode().lower().encode() for t in plain]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))))
        data = np.frombuffer(b"".join(plain), np.uint8)
        if len(data):
            at, kind = starts(data, offsets, self.spaced)
            ids, ends = self._tokens(data, at, None if self.spaced else (kind == BLANK) | (kind == WHITE))
            first = ends[np.searchsorted(at, offsets)]
        else:
            ids, first = np.empty(0, np.uint32), np.zeros(len(batch) + 1, np.int64)
        if not odd:
            return ids, first
        parts = [odd.get(i, ids[first[i] : first[i + 1]]) for i in range(len(batch))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _tokens(self, data: np.ndarray, at: np.ndarray, dropped: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens at ``at``, and how many ids stand before each of them and at the end."""
        offs = np.concatenate((at, [len(data)])).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        kept, flat, size, end = self.kept, [], [], self.end
        if len(kept) >= PIECES_KEPT:
            kept.clear()
        encode = self.core.encode_single_piece
        for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            got = kept.get(p)
            if got is None:
                got = encode(p + end)
                if len(p) <= PIECE_BYTES and len(kept) < PIECES_KEPT:
                    kept[p] = got
            flat += got
            size.append(len(got))
        index = coded.indices.to_numpy()
        size = np.array(size, np.int32)
        if dropped is not None:
            lens = np.where(dropped, 0, size[index])
        else:
            lens = size[index]
        ends = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        pool = self.ids[np.array(flat, np.int64)]
        base = np.concatenate(([0], np.cumsum(size[:-1], dtype=np.int64)))[index] - ends[:-1]
        return pool[np.repeat(base, lens) + np.arange(ends[-1])], ends
