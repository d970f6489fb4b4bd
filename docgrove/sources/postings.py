"""A kept posting index: which documents hold a word, how often and where.

A store is a folder of segments. A segment has

* ``forward``: id, length, norm and words (term, tf, places) of its documents, sorted
  by a bucket of the id, so that the words of a few documents are a few pages;
* ``postings``: term, id, tf, length, norm, places, in buckets by term, of one or more
  files sorted by term, so that a word's rows are a few row groups;
* ``terms``: term, df, cf, sorted by term; a segment that replaces documents holds
  differences, so that sums over segments are right;
* ``gone``: ids that the segment replaced in earlier ones.

A change writes one small segment for the changed documents alone; ``compact``
merges all into one. A manifest, published last, lists segments and totals;
readers keep the version that they opened.

Texts are shuffled once, before they are analysed; their words are counted within
tasks, and postings shuffled as compressed blocks (see ``blocks``) to parts of a size
that a task sorts in memory. A hot word's rows lie in as many parts as its bucket has.
Nothing is collected but numbers of the query's own words and at most ``FEW`` changed ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import BUCKETS
from .folders import Folder

FEW = 1000
#: As many replaced ids are sent to all executors (8 bytes each); with more, documents' words are shuffled to meet them.
SENT = 2_000_000
#: Bytes of forward rows whose postings, some million, make a part.
PART = 8 << 20


class PostingStore:
    def __init__(self, spark: SparkSession, path: str, id_col: str, id_type: str = "bigint") -> None:
        self.spark, self.id, self.folder = spark, id_col, Folder(spark, path)
        ident = f"`{id_col}` {id_type}"
        self._schema = {
            "forward": f"{ident}, length bigint, words array<struct<term: string, tf: bigint, places: array<int>>>, norm double, bucket int",
            "postings": f"term string, {ident}, tf bigint, length bigint, norm double, places array<int>, bucket int",
            "terms": "term string, df bigint, cf bigint",
            "gone": ident,
        }
        self._df: dict[str, int] = {}
        self._kept: DataFrame | None = None
        versions = self.folder.versions()
        self.version = versions[-1] if versions else 0
        self.state: dict = self.folder.load(self.version) if versions else {"segments": [], "documents": 0, "words": 0}

    # reading

    def _read(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.schema(self._schema[table]).parquet(f"{self.folder.path}/{segment}/{table}")

    def _bucket(self, c: str | Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")

    def _live(self, table: str, some: Column | Callable[[dict], Column] | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """Rows of all segments, without documents that a later one replaced; ``some`` may be a function of a segment."""
        parts, gone, many = [], [], 0
        for s in reversed(self.state["segments"]):
            rows = self._read(s["name"], table)
            rows = rows if some is None else rows.where(some(s) if callable(some) else some)
            rows = rows if only is None else rows.join(only, self.id, "left_semi")
            if gone:
                rows = rows.join(self._sent(reduce(DataFrame.union, gone), many), self.id, "left_anti")
            parts.append(rows)
            if s["gone"]:
                gone.append(self._read(s["name"], "gone"))
                many += s.get("ids", SENT + 1)
        return reduce(DataFrame.unionByName, parts) if parts else None

    @staticmethod
    def _sent(ids: DataFrame, many: int) -> DataFrame:
        return F.broadcast(ids) if many <= SENT else ids

    def statistics(self, words: Iterable[str]) -> tuple[int, int, dict[str, int]]:
        """Documents, their words, and how many documents hold each of the given words; known numbers are remembered."""
        words = sorted(set(words))
        new = [w for w in words if w not in self._df]
        if new and self.state["segments"]:
            rows = reduce(DataFrame.union, [self._read(s["name"], "terms").where(F.col("term").isin(*new)).select("term", "df") for s in self.state["segments"]])
            found = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
            self._df.update({w: found.get(w, 0) for w in new})
        return self.state["documents"], self.state["words"], {w: self._df.get(w, 0) for w in words}

    def postings(self, words: list[str]) -> DataFrame:
        """term, id, tf, length, norm, places of the given words."""
        if self._kept is not None:
            return self._kept.where(F.col("term").isin(*words))
        some = F.col("term").isin(*words)
        buckets = {"crc32": sorted({blocks.bucket_of(w.encode()) for w in words})}
        if not all("hash" in s for s in self.state["segments"]):  # segments of earlier versions
            buckets["xxhash64"] = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[self._bucket(F.lit(w)) for w in words]))).distinct().collect()]
        return self._live("postings", lambda s: F.col("bucket").isin(*buckets[s.get("hash", "xxhash64")]) & some).drop("bucket")

    def matching(self, prefix: str, pattern: str) -> DataFrame:
        """term, id, tf, length, norm, df of the words that match a pattern with a literal beginning."""
        some = F.col("term").startswith(prefix) & F.col("term").rlike(pattern)
        terms = reduce(DataFrame.union, [self._read(s["name"], "terms").where(some).select("term", "df") for s in self.state["segments"]])
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
        rows = self._kept.where(some) if self._kept is not None else self._live("postings", some)
        return rows.select("term", self.id, "tf", "length", "norm").join(terms, "term")

    def cache(self) -> "PostingStore":
        """Keep the postings in memory and on disk of the executors, by term."""
        rows = self._live("postings")
        if rows is not None and self._kept is None:
            self._kept = rows.drop("bucket").hint("rebalance", "term").sortWithinPartitions("term").persist()
        return self

    # writing

    def spread(self, documents: DataFrame) -> DataFrame:
        """The documents in the order of forward rows. Few bytes move if this is done before their texts are analysed."""
        return documents.withColumn("_docgrove_bucket", self._bucket(self.id)).hint("rebalance", "_docgrove_bucket").sortWithinPartitions("_docgrove_bucket", self.id)

    def _forward(self, rows: DataFrame, unique: bool = False) -> DataFrame:
        """Forward rows of (id, terms). Rows that repeat an id become one document, with a gap between them."""
        if not unique and rows.groupBy(self.id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect():
            gap = F.array(F.lit(None).cast("string"))
            rows = rows.where(F.col("terms").isNotNull()).groupBy(self.id).agg(F.flatten(F.collect_list(F.concat("terms", gap))).alias("terms"))
        return rows.select(self.id, "terms", self._bucket(self.id).alias("bucket")).mapInArrow(blocks.count_words(self.id), self._schema["forward"])

    def _postings(self, forward: DataFrame, path: str) -> DataFrame:
        """Postings of forward rows that were written to a folder."""
        parts = max(1, -(-self.folder.size(path) // PART))
        slices = -(-parts // BUCKETS)
        packed = forward.select(self.id, "length", "norm", "words").mapInArrow(blocks.pack(slices, parts), "part int, block binary")
        packed = packed.repartitionById(slices * BUCKETS if slices > 1 else parts, "part")
        return packed.mapInArrow(blocks.unpack(self.id), self._schema["postings"])

    def _write(self, forward: DataFrame, minus: DataFrame | None, gone: bool, name: str | None = None) -> tuple[dict, int, int]:
        """A segment of these documents; its entry, documents and words."""
        name = name or self._name()
        at = f"{self.folder.path}/{name}"
        forward.write.parquet(f"{at}/forward")
        forward = self._read(name, "forward")
        self._postings(forward, f"{name}/forward").sortWithinPartitions("bucket", "term", self.id).write.partitionBy("bucket").parquet(f"{at}/postings")
        signed = self._read(name, "postings").select("term", F.lit(1).alias("d"), "tf")
        if minus is not None:
            signed = signed.union(minus.select(F.explode("words").alias("w")).select("w.term", F.lit(-1), -F.col("w.tf")))
        terms = signed.groupBy("term").agg(F.sum("d").alias("df"), F.sum("tf").alias("cf"))
        terms.orderBy("term").write.parquet(f"{at}/terms")
        total = forward.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first()
        return {"name": name, "gone": gone, "hash": "crc32"}, total["n"], total["w"]

    @staticmethod
    def _name() -> str:
        return f"s-{uuid.uuid4().hex}"

    def _publish(self, segments: list[dict], documents: int, words: int) -> None:
        self.version += 1
        self.state = {"segments": segments, "documents": documents, "words": words}
        self.folder.publish(self.version, self.state)
        self._df = {}
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None
            self.cache()

    def write(self, rows: DataFrame) -> "PostingStore":
        """Index (id, terms) anew; null terms are documents without a text."""
        entry, n, words = self._write(self._forward(rows), None, False)
        self._publish([entry], n, words)
        return self

    def update(self, ids: DataFrame, rows: DataFrame | None) -> "PostingStore":
        """Replace the documents of the given ids by (id, terms) rows; without rows they are deleted."""
        name = self._name()
        ids.select(self.id).distinct().write.parquet(f"{self.folder.path}/{name}/gone")
        ids = self._read(name, "gone")
        many = ids.count()
        few = [r[0] for r in ids.limit(FEW + 1).collect()]
        buckets = [r[0] for r in ids.select(self._bucket(self.id)).distinct().collect()]
        some = F.col("bucket").isin(*buckets)
        old = self._live("forward", some & F.col(self.id).isin(*few)) if len(few) <= FEW else self._live("forward", some, self._sent(ids, many))
        total = old.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first() if old is not None else {"n": 0, "w": 0}
        if rows is None:
            rows = ids.select(self.id, F.lit(None).cast("array<string>").alias("terms")).limit(0)
        entry, n, words = self._write(self._forward(rows, True), old, True, name)
        self._publish([*self.state["segments"], entry | {"ids": many}], self.state["documents"] + n - total["n"], self.state["words"] + words - total["w"])
        return self

    def compact(self) -> "PostingStore":
        """Merge all segments into one; the old ones go with their versions."""
        live = self._live("forward")
        if live is None or len(self.state["segments"]) == 1:
            return self
        old, before = self.state["segments"], self.version
        entry, n, words = self._write(live.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.id), None, False)
        self._publish([entry], n, words)
        for v in [v for v in self.folder.versions() if v <= before]:
            self.folder.remove(f"v{v}.json")
        for s in old:
            self.folder.remove(s["name"])
        return self

    def documents(self) -> DataFrame | None:
        """id, length, norm of the indexed documents."""
        live = self._live("forward")
        return None if live is None else live.select(self.id, "length", "norm")
