"""Byte-level BPE ids of whole batches.

Pre-tokens are cut for a whole chunk at once from code point classes (the
classes are asked of the tokenizer itself, code point by code point, as they
occur), and their ids come from a table that each Python worker fills as it
meets new pre-tokens. The ids are those of the public tokenizer on whole texts;
a special token's string is cut out first and gets that token's id, as there.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator

import numpy as np

from . import spans as S

L, N, O, W, UNKNOWN = 1, 2, 3, 4, 255
MAX_PIECES = 1 << 21


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids for flat UTF-8 chunks; keeps its tables for the life of a worker."""

    def __init__(self, path: str | None = None, ranks_path: str | None = None) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        with open(ranks_path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.mask = np.uint64(2 * MAX_PIECES - 1)
        self.keys = np.zeros(2 * MAX_PIECES, np.uint64)
        self.entry = np.zeros(2 * MAX_PIECES, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.place = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n, self.used = 1, 1  # entry 0 is a document's end: the id 0
        self.count[0] = 1

    def _classify(self, points: np.ndarray) -> None:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            kind = W
            for mate, k in (("a", L), ("1", N), ("!", O)):
                if len(split(mate + c)) == 1:
                    kind = k
            self.kind[p] = kind

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the pre-tokens, and their number for each document."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if not len(lead):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(offsets) - 1, np.int64)
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        c = self.kind[point]
        if (new := c == UNKNOWN).any():
            self._classify(np.unique(point[new]))
            c = self.kind[point]
        n = len(point)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(lead, offsets)] = True  # documents' starts, and the end
        start = np.ones(n + 1, bool)
        np.not_equal(c[1:], c[:-1], out=start[1:n])
        start |= first
        # white space before something else: its last character stands alone or, if a space, joins what follows
        last = np.flatnonzero((c == W) & start[1:] & ~first[1:])
        start[last] = True
        start[last[point[last] == 0x20] + 1] = False
        # contractions
        for i in np.flatnonzero((point == 0x27) & start[:n]).tolist():
            tail = "".join(map(chr, point[i + 1 : i + 3].tolist()))
            if first[i + 1]:
                continue
            if tail[:1] in ("s", "t", "m", "d"):
                k = 1
            elif tail in ("re", "ve", "ll") and not first[i + 2]:
                k = 2
            else:
                continue
            start[i + 1] = False
            if i + 1 + k < n and c[i + 1 + k] == L:
                start[i + 1 + k] = True
        at = np.flatnonzero(start[:n])
        begin = lead[at]
        counts = np.diff(np.searchsorted(begin, offsets))
        return begin, np.append(begin[1:], len(data)), counts

    def _apart(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Pre-tokens of a chunk that holds special tokens' strings, each of these being one; None if it holds none."""
        raw = data.tobytes()
        found = sorted((m.start(), m.end()) for x in self.special if x in raw for m in re.finditer(re.escape(x), raw))
        doc = np.searchsorted(offsets, [a for a, _ in found], "right")
        found = [(a, b) for (a, b), d in zip(found, doc.tolist()) if b <= offsets[d]]  # none across documents
        if not found:
            return None
        a, b = np.array(found).T
        starts, ends, _ = self.pieces(data, np.unique(np.concatenate([offsets, a, b])))
        of = np.searchsorted(a, starts, "right") - 1
        outside = (of < 0) | (starts >= b[of])
        starts, ends = np.concatenate([starts[outside], a]), np.concatenate([ends[outside], b])
        by = np.argsort(starts)
        return starts[by], ends[by], np.diff(np.searchsorted(starts[by], offsets))

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        key = self.keys[slot]
        hit = key == h
        out = np.where(hit, self.entry[slot], np.int64(-1))
        todo = np.flatnonzero(~hit & (key != 0))
        slot = (slot[todo] + np.uint64(1)) & self.mask
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def _learn(self, h: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        single = self.single
        pieces = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        ids = list(map(single, pieces))
        for k in [k for k, x in enumerate(pieces) if x in self.special]:
            ids[k] = [self.special[pieces[k]]]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count.sum()))
        n, used = self.n + len(ids), self.used + len(flat)
        if n > len(self.count):
            self.count = np.resize(self.count, max(n, 2 * len(self.count)))
            self.place = np.resize(self.place, len(self.count))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, max(used, 2 * len(self.ids)))
        self.count[self.n : n] = count
        self.place[self.n : n] = self.used + np.cumsum(count) - count
        self.ids[self.used : used] = flat
        entry = np.arange(self.n, n)
        self.n, self.used = n, used
        slot = h & self.mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of two that want a slot, the last stays
            won = free & (self.keys[slot] == h)
            self.entry[slot[won]] = entry[won]
            on = ~won
            h, entry, slot = h[on], entry[on], (slot[on] + np.uint64(1)) & self.mask

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's documents, each ended by id 0, and the documents' borders among them."""
        starts, ends, counts = self._apart(data, offsets) or self.pieces(data, offsets)
        h = S.hash_spans(data, starts, ends)
        h |= np.uint64(h.size > 0) * (h == 0)
        found = self._find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            if self.n + len(new) > MAX_PIECES:
                self._reset()
                new, at = np.unique(h, return_index=True)
                missing = np.arange(len(h))
            self._learn(new, missing[at], data, starts, ends)
            found[missing] = self._find(h[missing])
        entry = np.insert(found, np.cumsum(counts), 0)
        count = self.count[entry]
        upto = np.cumsum(count)
        where = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.place[entry] - (upto - count), count)
        ids = self.ids[where]
        border = np.concatenate([[0], upto[np.cumsum(counts + 1) - 1]]) if len(counts) else np.zeros(1, np.int64)
        return ids, border


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder of a vocabulary file (its ranks beside it under the same name)."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path, path.rsplit(".", 1)[0] + ".tiktoken")
    return _encoders[path]


def forget() -> None:
    """Let go of this worker's encoders."""
    _encoders.clear()


def encoded(data: np.ndarray, offsets: np.ndarray, path: str | None = None) -> Iterator[np.ndarray]:
    """Each document's ids, with the end."""
    own = encoder(path)
    for lo, hi in S.chunks(offsets):
        ids, border = own.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
            yield ids[a:b]
