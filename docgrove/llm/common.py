"""What several operators share: shared-folder tables, ordered row numbers, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_folder: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context, so that workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parents[2]
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="docgrove-ship-")) / f"{package.name}_src.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(x for x in package.rglob("*") if x.suffix in (".py", ".txt")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="docgrove-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/docgrove-{uuid.uuid4().hex}"


def save(df: DataFrame, partition: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docgrove_path = path
    return back


def same_table(view: DataFrame, of: DataFrame) -> DataFrame:
    """Mark a view of a written table, so that discarding the view deletes the table."""
    view._docgrove_path = vars(of).get("_docgrove_path")
    return view


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = vars(df).get("_docgrove_path")
        if path:
            remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver notice dropped plans, so that their shuffle files go before the next stage writes its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map that hands freed memory back to the system when it ends: Python workers live on and would hold it.

    Unless it ``encodes``, it also drops the tokenizer's tables that the worker holds from another stage.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        from . import bpe

        if not encodes:
            bpe.forget()
        try:
            yield from fn(it)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def roomy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``lean`` map that keeps up to 32 MB of freed memory while it runs.

    Otherwise each array of some 100 KB and more may be mapped anew, and clearing its pages costs more than filling it.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
        if mallopt is not None:
            mallopt(-3, 16 << 20)  # arrays below this are taken from the heap
            mallopt(-1, 32 << 20)  # free at the heap's end beyond which it shrinks
        yield from fn(it)

    return lean(run, encodes=True)


def batches_of(it: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    """Gather Arrow batches to about ``max_bytes``; a larger batch is cut into slices, at least one row each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in it:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1))) if b.nbytes > max_bytes else b.num_rows
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            held.append(part)
            size += part.nbytes
            if size >= max_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def numbered(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """Rows with a gapless ``name`` (from 0) in the given order, and their number.

    A range sort is written out; rows then count from their partition's offset.
    Only one count for each partition reaches the driver.
    """
    if not order:
        raise ValueError("an order is needed")
    t = save(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in t.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), part + 1)
    out = t.withColumn(name, offset + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    return same_table(out, t), total


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
        x, y = up[x], up[y]
        rest = x != y
        x, y = x[rest], y[rest]
    return nodes, nodes[up]


FOREST_EDGES = 2_000_000


def _local_forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges as stars to the smallest node of each local component."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def stars() -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = _roots(a, b)
        own = nodes != roots
        return nodes[own], roots[own]

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], ["a", "b"])

    held, size = [], 0
    for batch in it:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= FOREST_EDGES:
            a, b = (np.concatenate([z, *[h[k] for h in held]]) for k, z in enumerate((a, b)))
            held, size = [], 0
            a, b = stars()
            if len(a) > FOREST_EDGES:  # bounds a task's memory; the pieces meet again in the rounds below
                yield from out()
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if held:
        a, b = (np.concatenate([z, *[h[k] for h in held]]) for k, z in enumerate((a, b)))
        a, b = stars()
    yield from out()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the edges ``a``, ``b`` (longs).

    Tasks contract their edges to forests, which fewer tasks take up again, as
    many as ``FOREST_EDGES`` need; one task's forest is the answer. Where that is
    too much for one, alternating large-star and small-star rounds, each written to
    the shared folder, go on until the edges are stars. Nodes in no edge are not listed.
    """
    schema = "a long, b long"
    step = save(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(lean(_local_forest), schema))
    n = step.count()
    tasks = -(-n // FOREST_EDGES)
    if n:
        forest = save(step.repartition(tasks, F.col("b")).mapInArrow(lean(_local_forest), schema))
        discard(step)
        step = forest
    if tasks < 2:
        roots = step.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return same_table(step.selectExpr("a AS node", "b AS component").union(roots), step)
    while True:
        both = step.union(step.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the lower neighbours of each node, and itself, go to the lowest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        stars = save(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        discard(step)
        # done when every node has one parent and no parent has one itself
        deep = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not deep:
            deep = stars.select(F.col("b").alias("a")).distinct().join(stars.select("a").distinct(), "a", "left_semi").limit(1).count()
        step = stars
        if not deep:
            roots = step.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return same_table(step.selectExpr("a AS node", "b AS component").union(roots), step)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"_{n}"
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out


def uniform(*columns, seed: int) -> object:
    """A reproducible number in (0, 1) of the given columns, alike in any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join many rows to one for each key (null equals null), a hot key being spread over ``salts`` tasks.

    ``right`` holds a key once; ``spread`` names a left column of many values.
    The salted side grows with the data, so it is merged, not broadcast.
    """
    names = {c: f"_r_{c}" for c in on}
    many = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_r_salt")).hint("merge")
    few = left.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    match = F.col("_salt") == F.col("_r_salt")
    for c in on:
        match = match & few[c].eqNullSafe(many[names[c]])
    return few.join(many, match, how).drop("_salt", "_r_salt", *names.values())


def class_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k1, k2, n_links, component_id) of classes of equal rows that are linked by pairs.

    ``classes``: k1, k2, node, least (smallest id of its rows), copies; ``pairs``:
    linked nodes a, b, each once. A row links with its own copies and with all
    rows of linked classes.
    """
    both = pairs.selectExpr("a", "b").union(pairs.selectExpr("b", "a"))
    linked = both.join(classes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("near"))
    of = classes.join(linked, "node", "left").join(components(pairs), "node", "left")
    of = save(of.select("k1", "k2", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "least"))
    first = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return salted_join(of, first, ["component"], "k2", "inner").select("k1", "k2", "n_links", "component_id")
