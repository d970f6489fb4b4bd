"""Embedding near-dedup by cross-polytope hashing.

Unit vectors are rotated by fast pseudo-random rotations (three rounds of random
signs and a Hadamard transform, padded to a power of two); the hash is the
closest signed axis. A table joins several such hashes; each vector enters,
beside its own bucket, the most promising neighbour buckets (multiprobe: the
next-best axes by the loss of inner product). Vectors that meet in a bucket of
equal labels are compared in double precision, and only pairs at or above the
threshold leave the task.

Scale: equal vectors of a label become one class first (partial aggregate), so
copies cost a row, not pairs. Buckets carry vectors of classes only, as single
floats where they came so. The hashes of a table are as many as keep
``OCCUPANCY`` vectors of the largest label in a bucket on average, so buckets
don't grow with the rows; the tables are as many as that needs for the recall.
A bucket of more than ``BLOCK`` rows is cut into blocks, and pairs of blocks are
separate tasks, so that a hot bucket spreads over the cluster; no bucket is
capped. Links are contracted to components (see ``common.components``).

Recall: the number of tables is settled by a trial on random pairs whose cosine
is the threshold, the hardest to find: at most ``MISS`` of them may share no
bucket (``tests/llm`` holds the operator to 0.97 against brute force); cosines
above are likelier to meet.

Defined cases: vectors that are null, empty, zero, or hold a null, NaN or
infinite component, and vectors with a null label, link with nothing: n_links 0,
component their own id. Vectors of unlike dimension aren't compared. Rows that
share a vec_id are vectors of their own, each with its row; a row with a null
vec_id counts as a link of others, but has no id to lend a component; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_links, salted_join, save
from .spans import mix

THRESHOLD = 0.93
PROBES = 2
BLOCK = 1024
OCCUPANCY = 256
MISS = 0.005
TRIALS = 4000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), normalised."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    rng = np.random.Generator(np.random.PCG64(seed))
    if n > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n))
    return x


def bucket_codes(x: np.ndarray, tables: int, hashes: int = 2, probes: int = PROBES, seed: int = 1, first: int = 0) -> np.ndarray:
    """Codes ``(rows, tables, 1 + probes)`` of the tables from ``first`` on: the own bucket of some joined hashes, then its best neighbours."""
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    m = 1 + probes
    ranks = [p for p in np.ndindex(*[m] * hashes) if np.prod(np.array(p) + 1) <= m]
    for t in range(tables):
        best, value = [], []
        for k in range(hashes):
            r = rotate(x, seed * 1_000_003 + (first + t) * hashes + k)
            if 2 * r.shape[1] < m:
                r = np.pad(r, ((0, 0), (0, m)))
            signed = np.concatenate([r, -r], 1)
            top = np.argpartition(-signed, m - 1, axis=1)[:, :m]
            v = np.take_along_axis(signed, top, 1)
            order = np.argsort(-v, axis=1, kind="stable")
            best.append(np.take_along_axis(top, order, 1).astype(np.uint64))
            value.append(np.take_along_axis(v, order, 1))
        loss = np.stack([sum((value[k][:, 0] - value[k][:, i]) ** 2 for k, i in enumerate(p)) for p in ranks], 1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :m]
        codes = []
        for p in ranks:
            c = np.full(len(x), first + t, np.uint64)
            for k, i in enumerate(p):
                c = mix(c * np.uint64(0x9E3779B97F4A7C15) + best[k][:, i])
            codes.append(c.astype(np.int64))
        out[:, t] = np.take_along_axis(np.stack(codes, 1), pick, 1)
    return out


_plans: dict[tuple, tuple[int, int]] = {}


def plan(dim: int, n: int, threshold: float = THRESHOLD, probes: int = PROBES, miss: float = MISS) -> tuple[int, int]:
    """Hashes of a table for ``n`` vectors of a label, and tables by which at most ``miss`` of pairs at the threshold go unmet."""
    axes = 2 << max(0, int(dim - 1).bit_length())
    hashes = 1
    while dim > 1 and n > OCCUPANCY * axes**hashes or hashes < 2:
        hashes += 1
    if (dim, hashes, threshold, probes, miss) not in _plans:
        rng = np.random.Generator(np.random.PCG64(77))
        a, b = (rng.normal(size=(TRIALS, dim)) for _ in range(2))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * b
        apart, tables = np.ones(TRIALS, bool), 0
        while apart.sum() > miss * TRIALS and tables < 512:
            x, y = (bucket_codes(v[apart], 1, hashes, probes, first=tables)[:, 0] for v in (a, b))
            apart[apart] = ~(x[:, :, None] == y[:, None]).any((1, 2))
            tables += 1
        _plans[dim, hashes, threshold, probes, miss] = hashes, tables
    return _plans[dim, hashes, threshold, probes, miss]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow or underflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(plans: dict[int, tuple[int, int]], probes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dim))
                hashes, tables = plans[dim]
                for lo in range(0, part.num_rows, 4096):
                    p = part.slice(lo, 4096)
                    codes = bucket_codes(_unit(_matrix(p.column(2))), tables, hashes, probes).reshape(p.num_rows, -1).astype(np.uint64)
                    label = p.column(1).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
                    codes = mix(codes ^ mix(label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))[:, None]).astype(np.int64)
                    at = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([p.column(0), pa.ListArray.from_arrays(at, pa.array(codes.reshape(-1)))], ["node", "codes"])

    return run


def _verified(node: np.ndarray, label: np.ndarray, x: np.ndarray, side: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs between two blocks of a bucket (or within one)."""
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    # the cosine of the two vectors decides; the margin covers the rounding of the matrix product
    near = (x[left] @ x[right].T >= threshold - 1e-9) & (label[left][:, None] == label[right])
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    return node[i[ok]], node[j[ok]]


def _links(threshold: float):
    """Rows sorted by (code, low, high): one comparison for each run of equal keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            code, low, high = (table[c].to_numpy() for c in ("code", "low", "high"))
            side, node, label = (table[c].to_numpy() for c in ("side", "node", "label"))
            dims = pa.compute.list_value_length(table["embedding"]).to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (dims[1:] != dims[:-1])) + 1
            got: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(code)]):
                if hi - lo > 1:
                    t = table.slice(lo, hi - lo).combine_chunks()
                    x = _unit(_matrix(t["embedding"].chunk(0)))
                    got.append(_verified(node[lo:hi], label[lo:hi], x, side[lo:hi], low[lo] == high[lo], threshold))
            if got:
                a, b = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in it:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            keys = [t[c].to_numpy() for c in ("code", "low", "high")]
            last = [k[-1] for k in keys]
            open_at = int(np.flatnonzero(~np.logical_and.reduce([k == v for k, v in zip(keys, last)])).max(initial=-1)) + 1
            if open_at:  # all before the last key is complete
                yield from pairs(pa.concat_tables([*held, t.slice(0, open_at)]))
                held = [t.slice(open_at)]
            else:
                before = held[-1] if held else None
                if before is not None and any(before[c][-1].as_py() != v for c, v in zip(("code", "low", "high"), last)):
                    yield from pairs(pa.concat_tables(held))
                    held = []
                held.append(t)
            size += 1
        if held:
            yield from pairs(pa.concat_tables(held))

    return run


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, once for each linked pair of ``node`` (distinct longs), ``label`` (int), ``embedding`` (floats or doubles, all usable)."""
    rows = vectors.select("node", F.col("label").cast("int").alias("label"), "embedding")
    # the largest label of each dimension: a row for each dimension there is
    largest = rows.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    plans = {r["dim"]: plan(r["dim"], r["n"], threshold, probes) for r in largest}
    if tables is not None:
        plans = {d: (hashes, tables) for d, (hashes, _) in plans.items()}
    hashed = save(rows.mapInArrow(_hashed(plans, probes), "node long, codes array<long>"))
    light = hashed.select("node", F.explode(F.array_distinct("codes")).alias("code"))
    sizes = light.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = salted_join(light, sizes, ["code"], "node", "inner")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("node", "code", low.alias("low"), high.alias("high"), F.when(F.col("own") == low, 0).otherwise(1).alias("side"))
    full = met.join(rows.hint("merge"), "node").select("code", "low", "high", "side", "node", "label", "embedding")
    full = full.repartition("code", "low", "high").sortWithinPartitions("code", "low", "high")
    return full.mapInArrow(_links(threshold), "a long, b long").distinct()


def near_dups(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, label, embedding."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    wide = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    bad = F.exists("_e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("_e") > 0) & ~bad & F.exists("_e", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), wide.alias("_e"))
    rows = rows.select("vec_id", "label", "_e", usable.alias("usable"), F.xxhash64("label", "_e").alias("k1"), F.xxhash64(F.lit(11), "_e", "label").alias("k2"))
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("_e").alias("embedding"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()))
    pairs = save(near_pairs(classes, threshold, tables, probes, block))
    of = class_links(classes, pairs)
    out = salted_join(rows.where("usable").select("vec_id", "k1", "k2", F.xxhash64("vec_id").alias("_v")), of, ["k1", "k2"], "_v", "inner")
    out = out.select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
