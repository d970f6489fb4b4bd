"""Best-fit packing of documents into sequences, bulk-synchronously.

Documents become token ids with an end (id 0); only those longer than a sequence
are cut, and all pieces but a document's first are then full. Pieces over half a
sequence open one. After that, in rounds: pieces and gaps are range-sorted by
size, and a sweep over the sorted order gives each gap, from the smallest up, the
largest piece that fits and isn't taken by a smaller gap. Every piece's
successor among the gaps is thus the smallest that holds it, and where several
want one gap, the rank decides: the largest piece wins and the others move on.
A sweep runs in each range at once and leaves a few unmatched gaps and pieces;
ranges are then matched to each other by their leftover counts alone, which is
the exact result of one sweep over all rows. Gaps are updated and the next round
begins. A gap with room for several of the largest remaining pieces enters as so
many gaps, so that rounds grow with the logarithm of pieces in a sequence. When
no piece fits any gap, the largest pieces open as many sequences as the words
left need at least.

Scale: texts are read once, by a map that keeps ids and length of each piece
(no text is shuffled); rounds work on (id, length) rows in the shared folder,
with ranges of ``ROWS_PER_RANGE`` rows cut by size and id, so equal lengths
spread. The driver sees counts for each range and a histogram of lengths.

Defined cases: a null or empty text is the one id 0; repeated rows are pieces of
their own under the same ``doc_id`` and ``piece``; an empty table gives no
sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .common import discard, lean, save

CAPACITY = 2048
ROWS_PER_RANGE = 1_000_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: the first may be shorter, the others are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def _pieces(capacity: int, path: str | None, with_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoded

        for b in it:
            data, offsets = S.flat(b.column(1))
            rows: list[tuple] = []
            size = 0
            for doc, ids in zip(b.column(0).to_pylist(), encoded(data, offsets, path)):
                raw = ids.astype("<u4", copy=False)
                for k, (s, n) in enumerate(cut(len(raw), capacity)):
                    part = raw[s : s + n].tobytes()
                    rows.append((doc, k, s, n, zlib.crc32(part), part if with_ids else None))
                    size += n * 4 * with_ids + 50
                if size > 8 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit) of each piece."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    out = rows.mapInArrow(lean(_pieces(capacity, path, with_ids), encodes=True), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


_STATE = "range int, kind string, at long, item long, seq long, length int, room int"


def _sweep_range(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's sweep: pairs of item and gap, then unmatched gaps and items in order."""
    from pyspark import TaskContext

    me = TaskContext.get().partitionId() if TaskContext.get() else 0
    stack: list[tuple[int, int]] = []
    pairs: list[tuple[int, int, int, int]] = []
    gaps: list[tuple[int, int]] = []
    for b in it:
        for size, is_gap, ident in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if not is_gap:
                stack.append((ident, size))
            elif stack:
                item, length = stack.pop()
                pairs.append((item, ident, length, size))
            else:
                gaps.append((ident, size))

    def out(kind: str, at, item, seq, length, room) -> Iterator[pa.RecordBatch]:
        n = len(at)
        for i in range(0, n, 200_000):
            c = slice(i, i + 200_000)
            m = len(at[c])
            yield pa.RecordBatch.from_arrays(
                [pa.array([me] * m, pa.int32()), pa.array([kind] * m), pa.array(at[c], pa.int64()), pa.array(item[c], pa.int64()), pa.array(seq[c], pa.int64()), pa.array(length[c], pa.int32()), pa.array(room[c], pa.int32())],
                ["range", "kind", "at", "item", "seq", "length", "room"],
            )

    none = [None]
    yield from out("pair", range(len(pairs)), [p[0] for p in pairs], [p[1] for p in pairs], [p[2] for p in pairs], [p[3] for p in pairs])
    yield from out("gap", range(len(gaps)), none * len(gaps), [g[0] for g in gaps], none * len(gaps), [g[1] for g in gaps])
    yield from out("item", range(len(stack)), [s[0] for s in stack], none * len(stack), [s[1] for s in stack], none * len(stack))


def across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """How leftover gaps meet leftover items of lower ranges.

    ``counts``: (range, unmatched gaps, unmatched items) in order. Gives
    (gaps' range, first gap, gaps, items' range, item of the first gap): the k-th
    of these gaps takes the item k below that.
    """
    stack: list[list[int]] = []
    out = []
    for r, gaps, items in counts:
        g = 0
        while g < gaps and stack:
            q, left = stack[-1]
            n = min(left, gaps - g)
            out.append((r, g, n, q, left - 1))
            g += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if items:
            stack.append([r, items])
    return out


def _sweep(items: DataFrame, gaps: DataFrame, n_rows: int, rows_per_range: int) -> tuple[DataFrame, DataFrame, bool]:
    """(pairs of item, seq, length; the written state; whether anything matched)."""
    spark = items.sparkSession
    ranges = max(1, -(-n_rows // rows_per_range))
    rows = items.select(F.col("length").alias("size"), F.lit(False).alias("gap"), F.col("item").alias("id")).union(gaps.select(F.col("part").alias("size"), F.lit(True), F.col("seq")))
    rows = rows.coalesce(1) if ranges == 1 else rows.repartitionByRange(ranges, "size", "gap", "id")
    state = save(rows.sortWithinPartitions("size", "gap", "id").mapInArrow(lean(_sweep_range), _STATE))
    seen: dict[int, dict[str, int]] = {}
    for r in state.groupBy("range", "kind").agg(F.count(F.lit(1)).alias("n")).collect():
        seen.setdefault(r["range"], {})[r["kind"]] = r["n"]
    pairs = state.where("kind = 'pair'").select("item", "seq", "length")
    matched = any("pair" in x for x in seen.values())
    crossing = across([(r, x.get("gap", 0), x.get("item", 0)) for r, x in sorted(seen.items())])
    if crossing:
        matched = True
        spread = spark.createDataFrame(crossing, "range int, low long, n long, to_range int, top long")
        g = state.where("kind = 'gap'").join(F.broadcast(spread), "range").where("at >= low AND at < low + n")
        g = g.select("seq", F.col("to_range").alias("range"), (F.col("top") - (F.col("at") - F.col("low"))).alias("at"))
        i = state.where("kind = 'item'").select("item", "length", "range", "at")
        pairs = pairs.union(i.join(g, ["range", "at"]).select("item", "seq", "length"))
    return pairs, state, matched


def exactly(rows: DataFrame, n: int, total: int) -> Column:
    """A condition that holds for ``n`` of ``total`` rows of distinct ``item``, in the order of a hash and the item.

    The border is narrowed down by histograms of 4096 bins.
    """
    if n >= total:
        return F.lit(True)
    h = F.pmod(F.xxhash64("item"), F.lit(1 << 48))
    low = 0  # rows below are chosen, n more are wanted of those from here on
    for shift in (36, 24, 12, 0):
        own = rows.where((h >= F.lit(low)) & (h < F.lit(low + (1 << shift + 12))))
        bins = {r["b"]: r["n"] for r in own.groupBy(F.shiftright(h - F.lit(low), shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(bins):
            if bins[b] > n:
                low += b << shift
                break
            n -= bins[b]
            if not n:
                return h < F.lit(low + (b + 1 << shift))
    last = [r["item"] for r in rows.where(h == F.lit(low)).orderBy("item").limit(n).collect()]  # rows of one 48-bit hash
    return (h < F.lit(low)) | ((h == F.lit(low)) & (F.col("item") <= F.lit(last[-1])))


def best_fit(items: DataFrame, capacity: int = CAPACITY, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(item, seq, length) for rows ``item`` (distinct longs), ``length`` (1 to ``capacity``)."""
    big = F.col("length") * 2 > capacity
    placed = [items.where(big).select("item", F.col("item").alias("seq"), "length")]
    free = save(items.where(~big).select("item", F.col("length").cast("int").alias("length")))
    gaps = save(items.where(big & (F.col("length") < capacity)).select(F.col("item").alias("seq"), (F.lit(capacity) - F.col("length")).cast("int").alias("room")))
    while True:
        left = {r["length"]: r["n"] for r in free.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity / 2 rows
        if not left:
            break
        most, least, total = max(left), min(left), sum(k * n for k, n in left.items())
        usable = gaps.where(F.col("room") >= least).agg(F.coalesce(F.sum("room"), F.lit(0)).alias("room")).first()["room"]
        if total > usable:
            # the largest pieces open what the words left need at least
            want, floor = -(-(total - usable) // capacity), 0
            for k in sorted(left, reverse=True):
                floor = k
                if left[k] >= want:
                    break
                want -= left[k]
            opens = F.col("length") > floor
            if want:
                own = free.where(F.col("length") == floor)
                opens = opens | ((F.col("length") == floor) & exactly(own, want, left[floor]))
            opened = save(free.where(opens).select("item", F.col("item").alias("seq"), "length"))
            placed.append(opened)
            gaps2 = save(gaps.where(F.col("room") >= least).union(opened.select("seq", (F.lit(capacity) - F.col("length")).cast("int"))))
            free2 = save(free.where(~opens))
            discard(free, gaps)
            free, gaps = free2, gaps2
        parts = F.greatest(F.lit(1), F.floor(F.col("room") / F.lit(most))).cast("int")
        several = gaps.where(F.col("room") >= least).select("seq", F.floor(F.col("room") / parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(1), parts)).alias("_k"))
        n_rows = sum(left.values()) + gaps.count()
        pairs, state, matched = _sweep(free, several, n_rows, rows_per_range)
        if matched:
            pairs = save(pairs)
            placed.append(pairs)
            used = pairs.groupBy("seq").agg(F.sum("length").alias("_used"))
            gaps2 = save(gaps.join(used, "seq", "left").select("seq", (F.col("room") - F.coalesce("_used", F.lit(0))).cast("int").alias("room")).where("room > 0"))
            free2 = save(free.join(pairs.select("item"), "item", "left_anti"))
            discard(free, gaps)
            free, gaps = free2, gaps2
        else:  # no piece fits: these gaps stay as they are
            discard(gaps)
            gaps = save(free.sparkSession.createDataFrame([], "seq long, room int"))
        discard(state)
    discard(free, gaps)
    out = placed[0]
    for p in placed[1:]:
        out = out.union(p.select("item", "seq", "length"))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each piece (see ``token_pieces``) with its ``sequence_id`` and ``offset`` there."""
    pieces = save(token_pieces(docs, capacity, path, with_ids, text).withColumn("_item", F.monotonically_increasing_id()))
    at = best_fit(pieces.select(F.col("_item").alias("item"), "length"), capacity, rows_per_range)
    before = Window.partitionBy("seq").orderBy(F.col("length").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select(F.col("item").alias("_item"), F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    return pieces.join(at, "_item").drop("_item")
