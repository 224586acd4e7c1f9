"""Versions of a table that are taken by compare and swap, and exports that are whole or not there (SK02, SK07, GR05).

Spark writes every version to a folder of its own; a version is published by renaming a
small file that names the folder, which fails if another writer has published that
version.  What a failed job has written is named by nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Moved(ValueError):
    """Another writer has published the version that was to be written."""


class Versions:
    """A folder of versions 0, 1, ... of one table, or of several that belong together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def latest(self) -> int:
        """The number of the newest version, -1 without any."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=-1)

    def manifest(self, version: int) -> dict:
        fs = self._fs()
        stream = fs.open(self._path(f"v{version}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def read(self, name: str = "table", version: int | None = None) -> DataFrame:
        m = self.manifest(self.latest() if version is None else version)
        return self.spark.read.schema(StructType.fromJson(m["tables"][name])).parquet(f"{self.folder}/{m['data']}/{name}")

    def commit(self, base: int, facts: dict | None = None, **tables: DataFrame) -> int:
        """Publishes tables as version base + 1; Moved if it is there already, and then nothing of them is readable."""
        fs, data = self._fs(), f"data-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.folder}/{data}/{name}")
            body = json.dumps({"data": data, "tables": {n: json.loads(df.schema.json()) for n, df in tables.items()}, **(facts or {})})
            draft, target = self._path(f"{data}/manifest.json"), self._path(f"v{base + 1}.json")
            out = fs.create(draft, False)
            out.write(bytearray(body.encode()))
            out.close()
            rename = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
            try:
                rename.rename(draft, target, self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    raise Moved(f"version {base + 1} of {self.folder} is there already") from e
                raise
        except BaseException:
            fs.delete(self._path(data), True)
            raise
        return base + 1


def export_layer(store: Versions, layer: str, tree: DataFrame, types: DataFrame, values: DataFrame) -> int:
    """SK02: paths, types and values of a layer as one version; an empty layer is refused."""
    own = tree.where(F.col("layer") == layer)
    if not own.limit(1).count():
        raise ValueError(f"layer {layer} has no nodes: nothing was exported")
    ids = own.select("walk_key", "path", "id").orderBy("walk_key")
    return store.commit(store.latest(), {"layer": layer}, ids=ids, types=types, values=values.where(F.col("layer") == layer).orderBy("walk_key", "line_no"))


def load_index(store: Versions, layer: str, live) -> tuple[DataFrame, bool]:
    """GR05: (path, id) of a layer from its export, and true; from `live()` and false where there is none, or one of another layer."""
    last = store.latest()
    if last >= 0 and store.manifest(last).get("layer") == layer:
        return store.read("ids", last).select("path", "id"), True
    return live().select("path", "id"), False
