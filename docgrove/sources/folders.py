"""Small files in folders of any Hadoop file system."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; under a local folder only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/docgrove-{uuid.uuid4().hex}"


class Folder:
    """A folder of numbered versions, each a small JSON file written whole or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def names(self, below: str = "") -> list[str]:
        at = self._path(f"{self.path}/{below}" if below else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.names() if n.startswith("v") and n.endswith(".json"))

    def load(self, version: int) -> Any:
        stream = self._fs.open(self._path(f"{self.path}/v{version}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, content: Any) -> None:
        """Readers see the version from the moment its file has its name."""
        part, whole = self._path(f"{self.path}/_v{version}.part"), self._path(f"{self.path}/v{version}.json")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        self._fs.delete(whole, False)
        self._fs.rename(part, whole)

    def size(self, name: str) -> int:
        """Bytes of all files below."""
        return self._fs.getContentSummary(self._path(f"{self.path}/{name}")).getLength()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)
