"""An extension: a document table kept up to date by a stream, the newest row of each id wins.

The table is cut into buckets by id. Each micro-batch is reduced to the newest
row of each id; it replaces an older one, not a newer one (a row may come late), and only the buckets that it touches are written anew; the others
stay where an earlier version wrote them. A version is published by a small
manifest, written last, that says where each bucket lies; a batch that is run
again after a failure writes the same version. Files that only versions before the
last ``KEPT`` use are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.folders import Folder
from ..sources.tables import one_each

BUCKETS = 64
KEPT = 2


def latest(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """The newest row of each id."""
    return one_each(rows, id_col, order)


class DocumentTable:
    """Versions of a document table under one folder."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.id, self.buckets = spark, path.rstrip("/"), id_col, buckets
        self._folder = Folder(spark, self.path)

    def _manifest(self, before: int | None = None) -> dict | None:
        done = [v for v in self._folder.versions() if before is None or v < before]
        return self._folder.load(done[-1]) if done else None

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of all buckets, or of some."""
        places: dict[str, list[int]] = {}
        for b, place in manifest["buckets"].items():
            if buckets is None or int(b) in buckets:
                places.setdefault(place, []).append(int(b))
        parts = [self.spark.read.parquet(*[f"{self.path}/{place}/_bucket={b}" for b in sorted(bs)]) for place, bs in sorted(places.items())]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def current(self, before: int | None = None) -> DataFrame | None:
        manifest = self._manifest(before)
        return None if manifest is None else self._rows(manifest)

    def merge(self, batch: DataFrame, version: int, order: str) -> None:
        """Write the version that the batch makes of the one before."""
        bucket = F.pmod(F.xxhash64(self.id), F.lit(self.buckets)).cast("int")
        manifest = self._manifest(before=version) or {"buckets": {}}
        rows = latest(batch, self.id, order).select(*batch.columns)
        touched = [r[0] for r in batch.where(F.col(self.id).isNotNull()).select(bucket).distinct().collect()]  # at most ``buckets``
        old = self._rows(manifest, touched)
        new = rows if old is None else latest(old.unionByName(rows.select(*old.columns)), self.id, order)
        place = f"d{version}"
        new.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{place}")
        self._folder.publish(version, {"buckets": manifest["buckets"] | {str(b): place for b in touched}})
        self._clean()

    def _clean(self) -> None:
        versions = self._folder.versions()
        used = {place for v in versions[-KEPT:] for place in self._folder.load(v)["buckets"].values()}
        for v in versions[:-KEPT]:
            self._folder.remove(f"v{v}.json")
        for name in self._folder.names():
            if name.startswith("d") and name not in used and int(name[1:]) < versions[-1]:
                self._folder.remove(name)

    def follow(self, stream: DataFrame, order: str, checkpoint: str) -> StreamingQuery:
        """Merge a stream's batches until it is stopped (here: until its input is used up)."""

        def each(batch: DataFrame, number: int) -> None:
            self.merge(batch, number + 1, order)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
