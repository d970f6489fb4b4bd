"""Vectorised byte kernels over Arrow string batches.

A batch of texts is one flat ``uint8`` buffer plus document offsets; words are
found and hashed for the whole buffer at once, so no Python object is made per
word. Buffers are walked in chunks of whole documents to stay cache-resident.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: word bytes of the license rule: ASCII letters and digits, and all non-ASCII bytes
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(0x5EED))
_CODES = _rng.integers(1, 2**64 - 1, 256, np.uint64, endpoint=True)
_CODES_LOWER = _CODES[_LOWER]
_BASE = int(_rng.integers(1, 2**64 - 1, dtype=np.uint64)) | 1
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 2**64))
        k = min(done, n - done)
        out[done : done + k] = out[:k] * step
        done += k
    return out


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(CHUNK_BYTES.bit_length(), int(n).bit_length())
        _powers[:] = [_geometric(_BASE, size), _geometric(pow(_BASE, -1, 2**64), size)]
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document counts of maximal runs of member bytes; runs end at document borders."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    inside = member[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    if len(border):
        border = np.unique(border)
        cut = border[inside[border] & inside[border - 1]]
        if len(cut):
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Words ``[^\x20\x09-\x0D]+``."""
    return spans(data, offsets, ~_SPACE)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are of words."""
    return ~_SPACE[data]


def alnum_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``."""
    return spans(data, offsets, _ALNUM)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A position-free 64-bit hash of each byte span (polynomial modulo 2**64, finalised)."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.multiply((_CODES_LOWER if lower else _CODES)[data], power[:n], out=acc[1:])
    np.cumsum(acc[1:], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def values(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What each span adds to the hash of a longer one that begins with it."""
    power, inverse = _power_tables(len(data) + 1)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * power[: len(data)])])
    return (acc[starts + lengths] - acc[starts]) * inverse[starts]


def hash_joined(value: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``hash_spans`` of spans given in pieces, by the pieces' ``values`` and lengths; ``first``: where spans' first pieces are."""
    upto = np.concatenate([[0], np.cumsum(lengths)])
    power, inverse = _power_tables(int(upto[-1]) + 1)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[upto[:-1]])])
    end = np.append(first[1:], len(value))
    return mix((acc[end] - acc[first]) * inverse[upto[first]] + (upto[end] - upto[first]).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else as it is."""
    return _LOWER[data]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b << np.uint64(21))) + np.uint64(0x632BE59BD9B4E019))


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    acc = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=acc[1:])
    return acc[offsets[1:]] - acc[offsets[:-1]]
