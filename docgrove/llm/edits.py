"""Each document beside the next one, by doc_id, and its half-replaced text.

Range borders are quantiles of the ids, so each range is one task; the first
document of each range is also sent to the range before it, as the next of that
range's last. Texts are shuffled once and sorted in their ranges; a task holds
one batch of documents at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as P
from . import spans as S

_BATCH = 256


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points of the following one, or all."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    if ranges < 2:
        return []
    at = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    return sorted({int(x) for x in at})


def _place(bounds: list[int]) -> F.Column:
    """The range of a doc_id: the number of bounds not above it, looked up in two steps; null comes first."""
    if not bounds:
        return F.lit(0)
    g = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + g] for i in range(0, len(bounds), g)]
    longs = [F.array(*[F.lit(b).cast("long") for b in x]) for x in groups]
    coarse = F.size(F.filter(F.array(*[F.lit(x[0]).cast("long") for x in groups]), lambda b: b <= F.col("doc_id")))
    fine = F.size(F.filter(F.element_at(F.array(*longs), F.greatest(coarse, F.lit(1))), lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull() | (coarse == 0), 0).otherwise((coarse - 1) * g + fine)


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, lead) in range partitions, sorted; ``lead`` marks a copy that only follows the rows before."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_range", _place(_bounds(rows.select("doc_id"), ranges)))
    # the first id of each range: one row for each range reaches the driver
    first = {r["_range"]: None if r["nulls"] else r["first"] for r in rows.groupBy("_range").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()}
    present = sorted(first)
    before = {b: a for a, b in zip([present[-1], *present], present)} if present else {}
    n = max(present, default=0) + 1
    lead_id = F.element_at(F.array(*[F.lit(first.get(i)).cast("long") for i in range(n)]), F.col("_range") + 1)
    lead_to = F.element_at(F.array(*[F.lit(before.get(i, 0)) for i in range(n)]), F.col("_range") + 1)
    own = F.struct(F.col("_range").alias("to"), F.lit(False).alias("lead"))
    copy = F.struct(lead_to.alias("to"), F.lit(True).alias("lead"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("doc_id").eqNullSafe(lead_id), F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", F.col("_to.to").alias("_range"), F.col("_to.lead").alias("lead"))
    rows = rows.repartitionById(max(n, 1), F.col("_range"))
    return rows.sortWithinPartitions("lead", F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text", "lead")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def out(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        texts = [*[r[1] for r in rows], following[1]]
        n = len(rows)
        changed = [edited(t, x) for t, x in zip(texts, texts[1:])]
        code, some = P.of_texts(texts)
        code2, some2 = P.of_texts(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                pa.array(P.packed_strings(code[:n], some[:n]), pa.string()),
                pa.array(P.packed_strings(code2, some2), pa.string()),
                pa.array(P.likeness_of(code[:n], some[:n], code2, some2), pa.float64()),
                pa.array(P.likeness_of(code[:n], some[:n], code[1:], some[1:]), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    ended = False
    for b in it:
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if ended:
                continue  # of several leads (rows that share the first id) the first counts
            if row[2]:
                if held:
                    yield out(held, row)
                held, ended = [], True
                continue
            if held and (size > 2 * S.CHUNK_BYTES or len(held) >= _BATCH):
                yield out(held, row)
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        raise ValueError("a range without the first document of the next")


def compare_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ascending by doc_id (nulls first, rows that share an id by text); the last
    document's next is the first, itself if it is alone.
    """
    return in_ranges(docs, ranges).mapInArrow(_compare, _SCHEMA)
