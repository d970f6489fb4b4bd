"""Document fingerprints by one-permutation MinHash.

Word shingles are hashed once; the top bits of a hash choose one of ``BINS``
bins, and each bin keeps its smallest hash. Empty bins are filled by optimal
densification: bin i copies from the bin that a 2-universal hash of (i, attempt)
names, the first attempt that finds a bin with a shingle of its own, so that all
documents try the same bins in the same order. Of each bin the low ``BITS`` bits
are stored. The likeness of two fingerprints is the share of equal bins,
corrected for the 2**-BITS of unlike bins that agree by chance.

Scale: a map over the scan in bounded chunks of whole documents, no shuffle;
fingerprints are fixed-size strings that join and group like any other.

Defined cases: a text of fewer words than a shingle is one shingle of them all;
a text without words (also null or empty) has the empty fingerprint, which is
like another empty one (1) and unlike any other (0); equal texts have equal
fingerprints; a null fingerprint gives a null likeness; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as S

BINS = 256
BITS = 8
SHINGLE = 3
_EMPTY = np.uint64(2**64 - 1)
_PRIME = 2_147_483_647
_rng = np.random.Generator(np.random.PCG64(0xF1))
_ATTEMPTS = _rng.integers(1, _PRIME, (4096, 3)).astype(np.int64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of a chunk's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    starts, ends, counts = S.words(data, offsets)
    h = S.hash_spans(data, starts, ends, lower=True)
    n = len(h)
    doc = np.repeat(np.arange(len(offsets) - 1), counts)
    first = np.cumsum(counts) - counts
    if not n:
        return h, doc
    acc = h.copy()
    for k in range(1, width):
        nxt = np.zeros(n, np.uint64)
        nxt[: n - k] = h[k:]
        inside = np.zeros(n, bool)
        inside[: n - k] = doc[k:] == doc[: n - k]
        acc = np.where(inside, S.pair_hash(acc, nxt), acc)
    full = np.zeros(n, bool)
    if n >= width:
        full[: n - width + 1] = doc[width - 1 :] == doc[: n - width + 1]
    short = np.flatnonzero((counts > 0) & (counts < width))
    full[first[short]] = True
    return acc[full], doc[full]


def fingerprints(data: np.ndarray, offsets: np.ndarray, bins: int = BINS, bits: int = BITS, width: int = SHINGLE) -> np.ndarray:
    """A ``(documents, bins)`` array of low-order bits; rows of documents without words hold 0."""
    n = len(offsets) - 1
    h, doc = shingle_hashes(data, offsets, width)
    low = np.full(n * bins, _EMPTY, np.uint64)
    bin_bits = np.uint64(64 - (bins - 1).bit_length())
    np.minimum.at(low, doc * bins + (h >> bin_bits).astype(np.int64), h)
    low = low.reshape(n, bins)
    own = low != _EMPTY
    out = low.copy()
    rows, cols = np.nonzero(~own & own.any(1, keepdims=True))
    for t in range(len(_ATTEMPTS)):
        if not len(rows):
            break
        a, b, c = _ATTEMPTS[t]
        source = ((a * cols + b * (t + 1) + c) % _PRIME) % bins
        good = own[rows, source]
        out[rows[good], cols[good]] = low[rows[good], source[good]]
        rows, cols = rows[~good], cols[~good]
    for r, k in zip(rows.tolist(), cols.tolist()):  # next to never: 4096 attempts failed
        near = np.flatnonzero(own[r])
        out[r, k] = low[r, near[np.argmin((near - k) % bins)]]
    packed = S.mix(out) & np.uint64((1 << bits) - 1)
    packed[~own.any(1)] = 0
    return packed.astype(np.uint8 if bits <= 8 else np.uint16), own.any(1)


def packed_strings(codes: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Base64 of the packed low-order bits; the empty string without words."""
    planes = ((codes[:, :, None] >> np.arange(bits - 1, -1, -1).astype(codes.dtype)) & 1).astype(np.uint8)
    rows = np.packbits(planes.reshape(len(codes), -1), axis=1) if len(codes) else np.zeros((0, 0), np.uint8)
    return [base64.b64encode(r.tobytes()).decode() if ok else "" for r, ok in zip(rows, some.tolist())]


def unpack(text: str, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    b = np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8))[: bins * bits].reshape(bins, bits)
    return (b * (1 << np.arange(bits - 1, -1, -1))).sum(1)


def corrected(equal: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The likeness from the share of equal bins."""
    chance = 2.0**-bits
    return np.clip((equal - chance) / (1 - chance), 0.0, 1.0)


def likeness(a: str | None, b: str | None, bins: int = BINS, bits: int = BITS) -> float | None:
    """Estimated likeness of two stored fingerprints."""
    if a is None or b is None:
        return None
    if not a or not b:
        return float(a == b)
    return float(corrected((unpack(a, bins, bits) == unpack(b, bins, bits)).mean(), bits))


def likeness_of(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Row by row, of unpacked fingerprints."""
    return np.where(a_some & b_some, corrected((a == b).mean(1), bits), (a_some == b_some).astype(float))


def of_texts(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts, and which have words."""
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
    data, offsets = S.flat(column)
    parts = [fingerprints(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in S.chunks(offsets)]
    if not parts:
        return np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def add_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) and the fingerprint of a text column."""
    carried = [c for c in (docs.columns if keep is None else keep) if c != name]
    n = len(carried)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(packed_strings(*of_texts(b.column(n))), pa.string())], [*b.schema.names[:n], name])

    rows = docs.select(*carried, F.col(text).cast("string").alias("_read"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.StringType())]))
