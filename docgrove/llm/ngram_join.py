r"""Exact n-gram Jaccard self-join by vertical partitioning.

A document's set: its distinct 2-word shingles (A-Z lower-cased; a one-word text
is one shingle). Two documents link when 100 * intersection >= ``percent`` * union.

1. Documents with equal sets form one class; only classes are compared.
2. Shingle counts: each batch's shingles, cut by hash into ranges and packed with
   their numbers, are added up in one array of a fixed size for each range.
3. The counts give the global n-gram order, rarest first: (count class of a
   sketch of ``SKETCH`` cells, hash). The order decides only how many candidates
   arise; any order gives the same links. By the prefix principle, linked classes
   share a shingle among their rarest ones. The order is cut into parts of even
   postings, and pairs that meet in a part, pass the length and position bounds
   and don't already share the shingle before are candidates. A
   shingle of more than ``HOT`` prefixes is cut into blocks, and pairs of blocks
   are compared in tasks of their own.
4. Classes in candidates are laid out in blocks, neighbours near each other. A
   pair of blocks with candidates is a unit of work: each class goes to the units
   that need it, once, however many of its pairs are there. First go bitmaps (two
   to four bits a shingle, each the parity of the shingles that fall on it): bits
   that differ bound the symmetric difference from below and so drop pairs.
5. The order is cut into ``FRAGMENTS`` fragments, ranges of equal mass. Of pairs
   that remain, each fragment of a unit holds its segments of the sets, counts
   partial overlaps by itself, and the counts are summed for each pair. The sum
   decides.

Scale: what is broadcast or collected has a fixed bound: the sketch (16 MB), a
Bloom filter (16 MB), at most ``SAMPLE`` sets (64 MB). Prefix postings go out
straight from the scan, at some 8 bytes each; texts are shuffled only for classes of pairs that the bitmaps leave.
Copies collapse map-side before any exchange, so a text of a third of the corpus
costs one entry a batch. Neither the numbers of fragments nor of units depend on
the cluster; the tasks that join prefixes grow with the postings.

Defined cases: null, empty or blank texts have empty sets: 0 shingles, linked
with nothing, component their own id; rows that repeat a doc_id are documents of
their own; a null doc_id links and counts, but lends no component id unless all
of a component are null; an empty table gives no rows; extra columns are ignored.
Sets are compared by 56-bit shingle hashes and told apart by 128-bit ones, never
by their words; candidates meet by 48 bits of the latter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .common import batches_of, class_links, discard, lean, release_shuffles, salted_join, save, unused

PERCENT = 60
SKETCH = 1 << 24
RANGES = 24
FRAGMENTS = 8
BATCH_BYTES = 16 << 20
POSTINGS = 4 << 20  # prefix postings of a task
SAMPLE_SIZE, SAMPLE_BATCH, SAMPLE = 8192, 4, 1000  # sets of at most so many shingles, so many of a batch and in all, by which the order is cut into parts
PAIRS = 30
HOT = 8192  # prefixes that hold a shingle before it is cut into blocks
UNIT_SHINGLES = 1 << 21  # of a block of classes
UNIT_CLASSES = 4096
_ONE = np.uint64(0x0123456789ABCDEF)
_LOW24 = np.uint64(0xFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (the top 56 bits) of each document of a chunk, sorted, and their numbers."""
    starts, ends, counts = S.words(data, offsets)
    h = S.hash_spans(data, starts, ends, lower=True)
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    pairs = S.pair_hash(h[:-1], h[1:]) & ~np.uint64(0xFF)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for d, (a, b) in enumerate(zip(at, at[1:])):
        if b - a > 1:
            u = np.unique(pairs[a : b - 1])
        elif b - a == 1:
            u = S.mix(h[a:b] ^ _ONE) & ~np.uint64(0xFF)
        else:
            continue
        sets.append(u)
        sizes[d] = len(u)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def sets_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = S.flat(column)
    parts = [shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in S.chunks(offsets)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 and 0 of the empty one."""
    border = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for salt in (0x1111, 0x2222_0000_0000):
        acc = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(S.mix(sets ^ np.uint64(salt)), out=acc[1:])
        total = S.mix(acc[border[1:]] - acc[border[:-1]] + sizes.astype(np.uint64))
        out.append(np.where(sizes > 0, total, np.uint64(0)).astype(np.int64))
    return out[0], out[1]


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)


def print_of(h: np.ndarray) -> np.ndarray:
    """The 24 bits that tell shingles of one range apart when they are counted."""
    return (h >> np.uint64(16)) & _LOW24


def cell_of(h: np.ndarray, ranges: int) -> np.ndarray:
    width = np.uint64(SKETCH // ranges)
    return range_of(h, ranges) * width + ((print_of(h) * width) >> np.uint64(24))


def _planes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).reshape(-1)


def _unplanes(b: np.ndarray, n: int) -> np.ndarray:
    count = len(b) // n
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = b.reshape(n, count).T
    return out.reshape(-1).view("<u8")


def squeeze(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned numbers, so many bytes each, as one compressed block; the first column is delta-coded if sorted."""
    n = len(columns[0][0])
    raw = np.concatenate([np.array([n, *[w for _, w in columns]], "<u8").view(np.uint8), *[_planes(x, w) for x, w in columns]])
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(block: bytes, k: int) -> list[np.ndarray]:
    size = int(np.frombuffer(block, "<u8", 1)[0])
    raw = np.frombuffer(pa.decompress(block[8:], size, codec="zstd", asbytes=True), np.uint8)
    head = raw[: 8 * (k + 1)].view("<u8")
    n, at, out = int(head[0]), 8 * (k + 1), []
    for w in head[1:].tolist():
        out.append(_unplanes(raw[at : at + n * int(w)], int(w)))
        at += n * int(w)
    return out


_A = "part int, payload binary, sample binary, doc_id long, n long, k1 long, k2 long"
_A_TYPES = [("part", pa.int32()), ("payload", pa.binary()), ("sample", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]


def _batch(types: list[tuple], **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types], [c for c, _ in types])


def first_of_class(k1: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A batch's rows that stand for their class; none for empty sets."""
    _, first = np.unique(k1, return_index=True)
    one = np.zeros(len(sizes), bool)
    one[first] = True
    return one & (sizes > 0)


def bitmaps(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set, a power of two of bits, at least two a shingle: each the parity of the shingles that fall on it."""
    width = np.maximum(64, 1 << np.ceil(np.log2(2.0 * np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(width)])
    at = ((sets >> np.uint64(8)) & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], sizes)
    raw = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[x:y] for x, y in zip((base[:-1] >> 3).tolist(), (base[1:] >> 3).tolist())]


def _count_postings(ranges: int):
    """Documents' sizes and keys, and packed shingle counts of the batch's classes by range."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches_of(it, BATCH_BYTES):
            sets, sizes = sets_of(t.column(1))
            k1, k2 = set_keys(sets, sizes)
            one = first_of_class(k1, sizes)
            h = sets[np.repeat(one, sizes)]
            # a few sets, by which the order is cut into even parts; they don't bear on any result
            border = np.concatenate([[0], np.cumsum(sizes)])
            few = np.flatnonzero(one & (sizes <= SAMPLE_SIZE))
            few = set(few[np.argsort(k1[few])[:SAMPLE_BATCH]].tolist())
            sample = [sets[border[d] : border[d + 1]].tobytes() if d in few else None for d in range(len(sizes))]
            yield _batch(_A_TYPES, part=np.arange(len(sizes)) % ranges, sample=sample, doc_id=t.column(0).combine_chunks(), n=sizes, k1=k1, k2=k2)
            key, times = np.unique((range_of(h, ranges) << np.uint64(24)) | print_of(h), return_counts=True)
            cut = np.searchsorted(key, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(24))
            for r in range(ranges):
                fp = key[cut[r] : cut[r + 1]] & _LOW24
                if len(fp):
                    yield _batch(_A_TYPES, part=[r], payload=[squeeze((np.diff(fp, prepend=np.uint64(0)), 3), (times[cut[r] : cut[r + 1]].astype(np.uint64), 4))])

    return run


_B = "kind int, doc_id long, n long, k1 long, k2 long, part int, cells binary, mass binary"
_B_TYPES = [("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32()), ("cells", pa.binary()), ("mass", pa.binary())]


def level(count: np.ndarray) -> np.ndarray:
    """A count as one byte, growing with its logarithm; 0 means that no two classes share the cell's shingles."""
    return np.minimum(255, np.round(8 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def _count_range(ranges: int):
    """Of one range: documents (kind 0) and sample sets (1) as they came, the sketch's cells and how many shingles have which level (2)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in it:
            docs = b.filter(pa.compute.is_null(b.column(1)))
            if docs.num_rows:
                yield _batch(_B_TYPES, kind=np.zeros(docs.num_rows, np.int32), **{c: docs[c] for c in ("doc_id", "n", "k1", "k2")})
                some = docs["sample"].drop_null()
                if len(some):
                    yield _batch(_B_TYPES, kind=np.ones(len(some), np.int32), n=pa.nulls(len(some), pa.int64()), cells=some)
            rest = b.filter(pa.compute.is_valid(b.column(1)))
            for r, payload in zip(rest["part"].to_pylist(), rest["payload"].to_pylist()):
                delta, times = unsqueeze(payload, 2)
                own = counts.setdefault(r, np.zeros(1 << 24, np.uint32))
                at = np.cumsum(delta).astype(np.int64)
                own[at] = np.minimum(own[at] + times, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        width = SKETCH // ranges
        for r, own in counts.items():
            cells = np.zeros(width, np.uint32)
            slices = []
            for lo in range(0, len(own), 1 << 20):
                fp = np.flatnonzero(own[lo : lo + (1 << 20)]) + lo
                slices.append((fp, (fp * width) >> 24))
                np.maximum.at(cells, slices[-1][1], own[fp])
            lv, mass = level(cells), np.zeros(256)
            for fp, cell in slices:
                mass += np.bincount(lv[cell], own[fp], minlength=256)
            yield _batch(_B_TYPES, kind=[2], part=[r], cells=[lv.tobytes()], mass=[mass.astype("<i8").tobytes()])

    return run


class Order:
    """The global n-gram order and its cut into fragments."""

    def __init__(self, cells: np.ndarray, mass: np.ndarray, ranges: int, fragments: int) -> None:
        self.cells, self.ranges, self.fragments = cells, ranges, fragments
        self.before = np.concatenate([[0], np.cumsum(mass)])[:-1].astype(float)
        self.mass, self.total = mass.astype(float), float(max(mass.sum(), 1))

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Sort keys: level, then hash."""
        return (self.cells[cell_of(h, self.ranges)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))

    def fragment(self, key: np.ndarray) -> np.ndarray:
        lv = (key >> np.uint64(56)).astype(np.int64)
        inside = (key & np.uint64((1 << 56) - 1)).astype(float) / float(1 << 56)
        return np.minimum((self.before[lv] + self.mass[lv] * inside) * self.fragments / self.total, self.fragments - 1).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """So many of the rarest shingles contain one that is shared with any linked set."""
    return n - -(-percent * n // 100) + 1


def first_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of a batch's classes, each once, their sizes and 48-bit names."""
    sets, sizes = sets_of(t.column(0))
    k1, _ = set_keys(sets, sizes)
    one = first_of_class(k1, sizes)
    return sets[np.repeat(one, sizes)], sizes[one], k1[one].view(np.uint64) >> np.uint64(16)


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes in 16 bits: as they are below 2**15, then by their logarithm."""
    return np.where(n < 1 << 15, n, np.minimum(65535, (1 << 15) + np.floor(2048 * (np.log2(np.maximum(n, 1)) - 15)))).astype(np.uint64)


def size_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which numbers a coded size lies."""
    c = code.astype(np.float64)
    low = np.where(c < 1 << 15, c, np.floor(2.0 ** (15 + (c - (1 << 15)) / 2048)) - 1)
    high = np.where(c < 1 << 15, c, np.ceil(2.0 ** (15 + (c + 1 - (1 << 15)) / 2048)) + 1)
    return low, np.where(c >= 65535, np.inf, high)


_D = "part int, classes binary, payload binary, name long, n long, bits binary"
_D_TYPES = [("part", pa.int32()), ("classes", pa.binary()), ("payload", pa.binary()), ("name", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())]


def _sorted_prefixes(o: Order, sets: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets' prefix keys in order, without those that no other class holds; their places, and how many of each set."""
    keys = o.keys(sets)
    border = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    pre, at, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(len(sizes), np.int64)
    for d, n in enumerate(sizes.tolist()):
        k = np.sort(keys[border[d] : border[d + 1]])
        single = int(np.searchsorted(k, np.uint64(1) << np.uint64(56)))
        p = k[single : prefix_length(n, percent)]
        times[d] = len(p)
        pre.append(p)
        at.append(np.arange(single, single + len(p)))
    return np.concatenate(pre), np.concatenate(at), times


def even_cuts(o: Order, sample: list[bytes], parts: int, percent: int) -> np.ndarray:
    """Keys that cut the order into ``parts``, half of them even in prefix postings and half in comparisons, as a sample of sets has them.

    A posting is compared with the others of its key, whose number its level tells; ``PAIRS`` comparisons cost as much as a posting.
    """
    sets = [np.frombuffer(x, "<u8") for x in sample]
    key = np.sort(_sorted_prefixes(o, np.concatenate([*sets, np.zeros(0, np.uint64)]), np.array([len(x) for x in sets], np.int64), percent)[0])
    if not len(key):
        return np.zeros(0, np.uint64)
    work = np.cumsum(1 + 2.0 ** ((key >> np.uint64(56)).astype(np.float64) / 8) / PAIRS)
    half = parts // 2
    even = (np.arange(1, half + 1) * len(key)) // (half + 1)
    busy = np.searchsorted(work, np.arange(1, parts - half) * (work[-1] / (parts - half)))
    return np.unique(key[np.minimum(np.concatenate([even, busy]), len(key) - 1)])


def _prefixes(order, cuts, parts: int, percent: int, hot: int):
    """Prefix postings of classes by part of the order, and the classes' bitmaps.

    A run is what a class has in one part: name, size, postings, place of the
    first, 40 bits of the key before it. A posting is 40 bits of its key (a chance
    meeting only adds a candidate). A hot key's posting is a run for each pair of blocks.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = Order(*order.value)
        for t in batches_of(it, BATCH_BYTES // 2):
            sets, sizes, names = first_rows(t)
            key, at, times = _sorted_prefixes(o, sets, sizes, percent)
            has = np.flatnonzero(times)
            if not len(has):
                continue
            yield _batch(_D_TYPES, part=(names[has] % np.uint64(parts)).astype(np.int32), name=names[has].astype(np.int64), n=sizes[has], bits=bitmaps(sets[np.repeat(times > 0, sizes)], sizes[has]))
            owner = np.repeat(np.arange(len(sizes)), times)
            place = (at * 255 // sizes[owner]).astype(np.uint64)
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            last = np.zeros(len(key), np.uint64)
            last[1:] = (S.mix(key[:-1] ^ np.uint64(5)) >> np.uint64(24)) | np.uint64(1)
            last[new] = 0
            to = np.searchsorted(cuts, key, "right")
            blocks = np.ceil(2.0 ** (((key >> np.uint64(56)).astype(np.float64) + 0.5) / 8) / hot).astype(np.int64)
            key, many = S.mix(key), blocks > 1
            new[1:] |= (to[1:] != to[:-1]) | many[1:] | many[:-1]
            if many.any():  # one copy for each block that this one meets
                mine = (S.mix(names[owner] ^ np.uint64(0xB10C)) % blocks.astype(np.uint64)).astype(np.int64)
                i = np.repeat(np.arange(len(key)), blocks)
                other = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                key, last, owner, place, mine, many, to, new = key[i], last[i], owner[i], place[i], mine[i], many[i], to[i], new[i]
                cell = (np.minimum(mine, other) << 32) | np.maximum(mine, other)
                key = np.where(many, S.mix(key ^ S.mix(cell.astype(np.uint64) + np.uint64(1))), key)
                to = np.where(many, (key % np.uint64(parts)).astype(np.int64), to)
                new |= many
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(parts + 1))
            code = size_code(sizes)
            for r in range(parts):
                m = by[cut[r] : cut[r + 1]]
                if len(m):
                    start = np.flatnonzero(new[m])
                    first, count = m[start], np.diff(np.append(start, len(m)))
                    runs = squeeze((names[owner[first]], 6), (code[owner[first]], 2), (count.astype(np.uint64), 4), (place[first], 1), (last[first], 5))
                    yield _batch(_D_TYPES, part=[r], classes=[runs], payload=[squeeze((key[m] >> np.uint64(24), 5))])

    return run


_C = "kind int, a long, b long, bits binary"
_C_TYPES = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("bits", pa.binary())]


def _candidates(percent: int):
    """Pairs of classes that first meet at a common prefix shingle within the bounds of length and position (kind 0); bitmaps as they came (1)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in it:
            maps = b.filter(pa.compute.is_valid(b["bits"]))
            if maps.num_rows:
                yield _batch(_C_TYPES, kind=np.ones(maps.num_rows, np.int32), a=maps["name"], b=maps["n"], bits=maps["bits"])
            rest = b.filter(pa.compute.is_null(b["bits"]))
            for classes, payload in zip(rest["classes"].to_pylist(), rest["payload"].to_pylist()):
                name, code, count, place, before = unsqueeze(classes, 5)
                count, key = count.astype(np.int64), unsqueeze(payload, 1)[0]
                last = np.zeros(len(key), np.uint64)
                last[1:] = key[:-1] | np.uint64(1 << 40)  # within a run it is the key before; unlike any that a run begins with
                start = np.cumsum(count) - count
                last[start] = before
                # at least the shingles from each posting on, by the place of its run
                high = np.minimum(size_bounds(code)[1], 1e18)
                rest = np.repeat(high * (1 - place.astype(np.float64) / 255) + 1 + start, count) - np.arange(len(key))
                held.append([np.repeat(name, count), np.repeat(code.astype(np.uint16), count), key, last, rest.astype(np.float32) * np.float32(1 + 1e-6)])
        if not held:
            return
        name, code, key, last, rest = (np.concatenate([x[i] for x in held]) for i in range(5))
        del held
        order = np.lexsort((name, code, key))  # by size within a key
        name, code = name[order], code[order]
        key, last, rest = key[order], last[order], rest[order]
        del order
        low, high = size_bounds(code)
        del code
        step, alive = 1, np.flatnonzero(key[1:] == key[:-1])
        found: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            p = np.concatenate(found)
            by = np.lexsort((p[:, 1], p[:, 0]))
            p = p[by]
            p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])]
            yield _batch(_C_TYPES, kind=np.zeros(len(p), np.int32), a=p[:, 0].astype(np.int64), b=p[:, 1].astype(np.int64))

        while len(alive):
            i, j = alive, alive + step
            near = 100 * high[i] >= percent * low[j]  # further ones are larger still
            alive, i, j = alive[near], i[near], j[near]
            need = percent * (low[i] + low[j]) / (100 + percent)
            ok = ((last[i] != last[j]) | (last[i] == 0)) & (name[i] != name[j]) & (np.minimum(rest[i], rest[j]) >= need)
            i, j = i[ok], j[ok]
            if len(i):
                found.append(np.stack([np.minimum(name[i], name[j]), np.maximum(name[i], name[j])], 1))
                size += len(i)
                if size > 4_000_000:
                    yield from flush()
                    found, size = [], 0
            step += 1
            alive = alive[alive + step < len(key)]
            alive = alive[key[alive + step] == key[alive]]
        if found:
            yield from flush()

    return run


def _in_blocks(shingles: int, classes: int):
    """Of ordered classes (node, n): the block of each and its place there."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, total, last, filled = TaskContext.get().partitionId() << 32, 0, -1, 0
        for b in it:
            n = b.column(1).to_numpy()
            if not len(n):
                continue
            upto = total + np.cumsum(np.maximum(n, -(-shingles // classes)))
            block = np.concatenate([[total], upto[:-1]]) // shingles
            start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            size = np.diff(np.append(start, len(n)))
            at = np.arange(len(n)) - np.repeat(start, size)
            if block[0] == last:
                at[: size[0]] += filled
            total, last, filled = int(upto[-1]), int(block[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block + me, pa.int64()), pa.array(at, pa.int32())], ["node", "block", "at"])

    return run


def _units(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in range(keys):
            x = b.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
            new[0] |= bool(held) and held[-1].column(c)[-1].as_py() != x[0]
        cut = np.flatnonzero(new).tolist()
        lo = 0
        for hi in [*cut, b.num_rows]:
            if hi in cut and (hi > lo or held):
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                yield pa.Table.from_batches(held)
                held = []
            elif hi > lo:
                held.append(b.slice(lo, hi - lo))
            lo = hi
    if held:
        yield pa.Table.from_batches(held)


def pack_pairs(i: np.ndarray, j: np.ndarray) -> bytes:
    """Pairs of places, sorted by the first."""
    by = np.lexsort((j, i))
    return squeeze((np.diff(i[by], prepend=0).astype(np.uint64), 4), (j[by].astype(np.uint64), 4))


def unpack_pairs(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    i, j = unsqueeze(block, 2)
    return np.cumsum(i).astype(np.int64), j.astype(np.int64)


def close_pairs(i: np.ndarray, j: np.ndarray, left: list[bytes], right: list[bytes], n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets may reach ``percent``, by their bitmaps folded to the smaller of the two."""
    wide, other = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    least = np.minimum(wide[i], other[j])
    out = np.zeros(len(i), bool)

    def folded(maps: list[bytes], width: np.ndarray, size: int) -> np.ndarray:
        m = np.zeros((len(maps), size // 8), np.uint64)
        for w in np.unique(width[width >= size]).tolist():
            own = np.flatnonzero(width == w)
            raw = np.frombuffer(b"".join([maps[x] for x in own.tolist()]), np.uint64).reshape(len(own), w // size, size // 8)
            m[own] = np.bitwise_xor.reduce(raw, 1)
        return m

    for size in np.unique(least).tolist():
        at = np.flatnonzero(least == size)
        used_l, i2 = np.unique(i[at], return_inverse=True)
        used_r, j2 = np.unique(j[at], return_inverse=True)
        a = folded([left[x] for x in used_l.tolist()], wide[used_l], size)
        b = folded([right[x] for x in used_r.tolist()], other[used_r], size)
        step = max(1, (8 << 20) // size)
        for lo in range(0, len(at), step):
            c = slice(lo, lo + step)
            differ = np.bitwise_count(a[i2[c]] ^ b[j2[c]]).sum(1, dtype=np.int64)
            both = n_left[i[at[c]]] + n_right[j[at[c]]]
            most = (both - differ) // 2
            out[at[c]] = 100 * most >= percent * (both - most)
    return out


def _sides(t: pa.Table, kind: str, at: str) -> list[tuple[pa.Table, np.ndarray]]:
    """Rows of the two sides, each place once, and for each place its row there."""
    k, place = t[kind].to_numpy(), t[at].fill_null(0).to_numpy()
    out = []
    for side in (0, 1):
        rows = np.flatnonzero(k == side)
        u, first = np.unique(place[rows], return_index=True)
        row = np.full(int(u.max(initial=-1)) + 1, -1, np.int64)
        row[u] = np.arange(len(u))
        out.append((t.take(rows[first]), row))
    return out


def _filter_units(percent: int):
    """Of each unit the pairs that the bitmaps leave, packed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(it, 2):
            (left, of_i), (right, of_j) = _sides(t, "kind", "i")
            pairs = t.filter(pa.compute.equal(t["kind"], 2))
            i, j = pairs["i"].to_numpy(), pairs["j"].to_numpy()
            ok = close_pairs(of_i[i], of_j[j], left["bits"].to_pylist(), right["bits"].to_pylist(), left["n"].to_numpy(), right["n"].to_numpy(), percent)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array([t["p"][0].as_py()]), pa.array([t["q"][0].as_py()]), pa.array([pack_pairs(i[ok], j[ok])], pa.binary())], ["p", "q", "pairs"])

    return run


def _needed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes that each unit needs, by side."""
    for b in it:
        for p, q, block in zip(*(b.column(c).to_pylist() for c in range(3))):
            for side, x in enumerate(unpack_pairs(block)):
                u = np.unique(x)
                m = len(u)
                yield pa.RecordBatch.from_arrays([pa.array([p] * m), pa.array([q] * m), pa.array([side] * m, pa.int32()), pa.array(u, pa.int32()), pa.array([(p, q)[side]] * m)], ["p", "q", "kind", "i", "block"])


_E = "p long, q long, part int, kind int, i int, payload binary"
_E_TYPES = [("p", pa.int64()), ("q", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("i", pa.int32()), ("payload", pa.binary())]


def _segments(order):
    """The classes' keys that others hold too, by fragment, for each unit that needs them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = Order(*order.value)
        for t in batches_of(it, BATCH_BYTES):
            sets, sizes = sets_of(t.column(0))
            k1, k2 = set_keys(sets, sizes)
            mine = (k1 == t.column(1).to_numpy()) & (k2 == t.column(2).to_numpy())
            keys = o.keys(sets)
            border = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            units = t.column(3)
            rows: list[tuple] = []
            for d in np.flatnonzero(mine).tolist():
                k = np.sort(keys[border[d] : border[d + 1]])
                k = k[np.searchsorted(k, np.uint64(1) << np.uint64(56)) :]
                cut = np.searchsorted(o.fragment(k), np.arange(o.fragments + 1)).tolist()
                parts = [(v, _planes(k[a:b], 8).tobytes()) for v, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                rows += [(u["p"], u["q"], v, u["kind"], u["i"], x) for u in units[d].as_py() for v, x in parts]
                if len(rows) > 20_000:
                    yield _batch(_E_TYPES, **{c: x for (c, _), x in zip(_E_TYPES, zip(*rows))})
                    rows = []
            if rows:
                yield _batch(_E_TYPES, **{c: x for (c, _), x in zip(_E_TYPES, zip(*rows))})

    return run


def _to_fragments(fragments: int):
    """Packed pairs of a unit to each of its fragments."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p, q, block in zip(*(b.column(c).to_pylist() for c in range(3))):
                yield _batch(_E_TYPES, p=[p] * fragments, q=[q] * fragments, part=range(fragments), kind=[2] * fragments, payload=[block] * fragments)

    return run


def partial_overlaps(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many keys the sets of each pair share; pairs are sorted by ``i``, a place below 0 has no keys."""
    out = np.zeros(len(i), np.int64)
    flat = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    ranks = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    border = np.concatenate([[0], np.cumsum([len(x) for x in left])]).astype(np.int64)
    second = border[-1] + np.concatenate([[0], np.cumsum([len(x) for x in right])]).astype(np.int64)
    mark = np.full(int(ranks.max(initial=0)) + 1, -1, np.int64)
    group = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    for lo, hi in zip(group.tolist(), [*group[1:].tolist(), len(i)]):
        x = i[lo]
        if x < 0:
            continue
        mark[ranks[border[x] : border[x + 1]]] = x
        for at in range(lo, hi, 4096):
            y = j[at : min(hi, at + 4096)]
            has = np.flatnonzero(y >= 0)
            start = second[y[has]]
            size = second[y[has] + 1] - start
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            hit = mark[ranks[k]] == x
            out[at + has] = np.bincount(np.repeat(np.arange(len(has)), size)[hit], minlength=len(has))
    return out


def _overlaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of a unit's pairs within one fragment."""
    for t in _units(it, 3):
        (left, of_i), (right, of_j) = _sides(t, "kind", "i")
        block = t.filter(pa.compute.equal(t["kind"], 2))["payload"][0].as_py()
        i, j = unpack_pairs(block)

        def rows(of: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.where(x < len(of), of[np.minimum(x, len(of) - 1)], -1) if len(of) else np.full(len(x), -1)

        sets = [[_unplanes(np.frombuffer(x, np.uint8), 8) for x in s["payload"].to_pylist()] for s in (left, right)]
        counts = partial_overlaps(rows(of_i, i), rows(of_j, j), *sets)
        part = t["part"][0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([t["p"][0].as_py()]), pa.array([t["q"][0].as_py()]), pa.array([squeeze((counts.astype(np.uint64), 5))], pa.binary()), pa.array([block if part == 0 else None], pa.binary())], ["p", "q", "counts", "pairs"]
        )


def _sum_overlaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of each pair, summed over the fragments."""
    for t in _units(it, 2):
        total = sum(unsqueeze(x, 1)[0].astype(np.int64) for x in t["counts"].to_pylist())
        i, j = unpack_pairs(t["pairs"].drop_null()[0].as_py())
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 100_000):
            s = some[lo : lo + 100_000]
            m = len(s)
            yield pa.RecordBatch.from_arrays([pa.array([t["p"][0].as_py()] * m), pa.array(i[s], pa.int32()), pa.array([t["q"][0].as_py()] * m), pa.array(j[s], pa.int32()), pa.array(total[s])], ["p", "i", "q", "j", "overlap"])


BLOOM_BITS = (1 << 20, 1 << 27)


def _bloom_places(x: np.ndarray, bits: int) -> np.ndarray:
    h = S.mix(x.astype(np.int64).view(np.uint64) ^ np.uint64(0xB100))
    mask = np.uint64(bits - 1)
    return np.concatenate([h & mask, (h >> np.uint64(32)) & mask]).astype(np.int64)


def _bloom(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for b in it:
            if b.schema.field(0).type == pa.binary():
                for x in b.column(0).to_pylist():
                    bits |= np.frombuffer(pa.decompress(x, len(bits), codec="zstd", asbytes=True), np.uint8)
            else:
                at = _bloom_places(b.column(0).drop_null().to_numpy(), size)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["bits"])

    return run


def possible_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among ``ids``, by a Bloom filter of at most 16 MB; all rows with a null one.

    It only spares the join that follows: rows it lets through by chance find no partner there.
    """
    size = int(min(max(1 << (10 * max(ids.count(), 1)).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1]))
    own = ids.mapInArrow(lean(_bloom(size)), "bits binary")
    own = own.repartition(16).mapInArrow(lean(_bloom(size)), "bits binary").repartition(1).mapInArrow(lean(_bloom(size)), "bits binary")
    shared = rows.sparkSession.sparkContext.broadcast(own.first()["bits"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(pa.decompress(shared.value, size // 8, codec="zstd", asbytes=True), np.uint8)
        for b in it:
            x = b.column(0)
            at = _bloom_places(pa.compute.fill_null(x, 0).to_numpy(zero_copy_only=False), size)
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).reshape(2, -1).all(0)
            yield b.filter(pa.array(hit | pa.compute.is_null(x).to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(lean(run), rows.schema)


def linked_classes(docs: DataFrame, percent: int = PERCENT, fragments: int | None = None, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, n, k1, k2; classes: k1, k2, node, least, copies, n; linked pairs of nodes: a, b, overlap)."""
    spark = docs.sparkSession
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    fragments = fragments or FRAGMENTS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(lean(_count_postings(ranges)), _A).repartitionById(ranges, F.col("part"))
    counted = save(counted.mapInArrow(lean(_count_range(ranges)), _B), "kind")
    release_shuffles(spark)
    documents = counted.where("kind = 0").select("doc_id", "n", "k1", "k2")
    classes = documents.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()))
    sketch = counted.where("kind = 2").select("part", "cells", "mass").collect()
    cells, mass = np.zeros(SKETCH, np.uint8), np.zeros(256, np.int64)
    width = SKETCH // ranges
    for r in sketch:
        cells[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["cells"], np.uint8)
        mass += np.frombuffer(r["mass"], "<i8")
    order = spark.sparkContext.broadcast((cells, mass, ranges, fragments))
    parts = max(RANGES, int(mass[1:].sum() * (100 - percent) / 100 / POSTINGS))
    sample = [r["cells"] for r in counted.where("kind = 1").select("cells").limit(SAMPLE).collect()]
    cuts = even_cuts(Order(cells, mass, ranges, fragments), sample, parts, percent)
    raw = rows.select("text").mapInArrow(lean(_prefixes(order, cuts, parts, percent, HOT)), _D).repartitionById(parts, F.col("part"))
    raw = save(raw.mapInArrow(lean(_candidates(percent)), _C), "kind")
    release_shuffles(spark)
    met = raw.where("kind = 0").select("a", "b")
    maps = raw.where("kind = 1").select(F.col("a").alias("name"), F.col("b").alias("n"), "bits")

    # classes of candidates in blocks, each near the least class that it met
    label = met.union(met.select("b", "a")).groupBy(F.col("a").alias("name")).agg(F.least("a", F.min("b")).alias("label"))
    named = save(classes.withColumn("name", F.shiftrightunsigned("k1", 16)).join(label, "name").select("name", "label", "node", "n", "k1", "k2", "least"))
    placed = named.select("label", "node", "n").orderBy("label", "node").select("node", "n").mapInArrow(lean(_in_blocks(UNIT_SHINGLES, UNIT_CLASSES)), "node long, block long, at int")
    placed = save(named.join(placed, "node").drop("label"))
    discard(named)
    ends = placed.select("name", "block", "at")
    pairs = met.distinct().join(ends.toDF("a", "ba", "ia"), "a").join(ends.toDF("b", "bb", "ib"), "b")
    low, high = F.struct(F.col("ba").alias("b"), F.col("ia").alias("i"), F.col("a").alias("n")), F.struct(F.col("bb").alias("b"), F.col("ib").alias("i"), F.col("b").alias("n"))
    pairs = pairs.select(F.least(low, high).alias("x"), F.greatest(low, high).alias("y")).selectExpr("x.b AS p", "y.b AS q", "x.i AS i", "y.i AS j", "x.n AS left", "y.n AS right")
    pairs = save(pairs)
    release_shuffles(spark)

    # bitmaps meet in units
    need = pairs.selectExpr("p", "q", "0 AS kind", "i", "left AS name").union(pairs.selectExpr("p", "q", "1", "j", "right")).distinct()
    need = need.join(maps, "name").select("p", "q", "kind", "i", F.lit(0).alias("j"), "n", "bits")
    unit = need.union(pairs.select("p", "q", F.lit(2).alias("kind"), "i", "j", F.lit(None).cast("long"), F.lit(None).cast("binary")))
    tight = unit.repartition("p", "q").sortWithinPartitions("p", "q", "kind").mapInArrow(lean(_filter_units(percent)), "p long, q long, pairs binary")
    tight = save(tight)
    discard(pairs, raw)
    release_shuffles(spark)

    # segments of what is left meet in the fragments of units
    use = tight.mapInArrow(lean(_needed), "p long, q long, kind int, i int, block long")
    use = use.join(placed.select("block", F.col("at").alias("i"), "node", "k1", "k2", "least"), ["block", "i"])
    use = use.groupBy("node").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("least").alias("_rep"), F.collect_list(F.struct("p", "q", "kind", "i")).alias("units"))
    use = save(use)
    some = possible_rows(rows, use.select("_rep"))
    held = some.join(use.hint("merge"), some["doc_id"].eqNullSafe(use["_rep"])).select("text", "k1", "k2", "units")
    parted = held.mapInArrow(lean(_segments(order)), _E).union(tight.mapInArrow(lean(_to_fragments(fragments)), _E))
    partial = parted.repartition("p", "q", "part").sortWithinPartitions("p", "q", "part", "kind").mapInArrow(lean(_overlaps), "p long, q long, counts binary, pairs binary")
    overlap = partial.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(lean(_sum_overlaps), "p long, i int, q long, j int, overlap long")
    ends = placed.select("block", "at", "node", "n")
    linked = overlap.join(ends.toDF("p", "i", "na", "n_a"), ["p", "i"]).join(ends.toDF("q", "j", "nb", "n_b"), ["q", "j"])
    linked = linked.where(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("overlap")))
    linked = save(linked.select(F.col("na").alias("a"), F.col("nb").alias("b"), "overlap"))
    discard(tight, use, placed)
    release_shuffles(spark)
    return documents, classes, linked


def near_documents(docs: DataFrame, percent: int = PERCENT, fragments: int | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id, and the set's keys k1 and k2, for each document."""
    documents, classes, pairs = linked_classes(docs, percent, fragments, text)
    of = class_links(classes.select("k1", "k2", "node", "least", "copies"), pairs)
    full = documents.where("n > 0").withColumn("_v", F.xxhash64("doc_id"))
    out = salted_join(full, of, ["k1", "k2"], "_v", "inner")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("n_links").alias("n_similar"), "component_id", "k1", "k2")
    none = documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), "k1", "k2")
    return out.union(none)


def kept_documents(docs: DataFrame, percent: int = PERCENT, fragments: int | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked documents the one with the smallest doc_id.

    Rows without words or with a null doc_id all stay; of rows that share the
    smallest doc_id of a group one stays, the first by length and hash of its text.
    """
    near = near_documents(docs, percent, fragments, text)
    key, rank, loose = unused(docs, "id", "rank", "loose")
    chosen = near.where("n_shingles > 0 AND component_id IS NOT NULL").select(F.col("component_id").alias(key)).distinct()
    rows = docs.withColumn(loose, F.col("doc_id").isNull() | ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    full = rows.where(~F.col(loose)).withColumn(key, F.col("doc_id").cast("long")).join(chosen.hint("merge"), key, "left_semi")
    first = Window.partitionBy(key).orderBy(F.length(text), F.xxhash64(text))
    full = full.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank, key)
    return full.unionByName(rows.where(F.col(loose))).drop(loose)
