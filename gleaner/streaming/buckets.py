"""State that outgrows a micro-batch: a table in hash buckets, versioned by manifests.

A row lives in the bucket of its key's hash. An update reads and rewrites only the buckets
that its rows fall in, into a new folder, and commits by putting one manifest in place: the
list of the folder that holds each bucket as of this version. Buckets that an update does
not touch are carried over by name, so what a batch writes follows the batch.

* Readers take the newest manifest and never see half an update.
* An update carries a mark (streaming query and batch number). A retried batch finds its
  mark in a manifest and changes nothing; one that failed before its manifest left a
  folder that no manifest names, and writes again.
* The last ``keep`` manifests stay readable; older ones go, with the folders that only
  they name. A reader of a version must finish within that many updates.

One writer at a time per table. Choose ``buckets`` so that one is one task's work; no more
than that many numbers and folder names are ever gathered on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path.rstrip("/"), key, buckets, max(keep, 1)

    # --- files ---------------------------------------------------------------------

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._file(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(name[2:-5]) for name in self._names("manifests") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """{version, mark, schema, folders: {bucket: folder}} of a version, by default the newest."""
        version = max(self.versions()) if version is None else version
        path, fs = self._file("manifests", f"v={version:012d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Put the manifest in place under its final name in one step."""
        draft, fs = self._file("manifests", f".{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        final, _ = self._file("manifests", f"v={manifest['version']:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was committed by another writer")

    def _clean(self) -> None:
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-self.keep :]]
        named = {folder.split("/")[0] for m in kept for folder in m["folders"].values()}
        for v in versions[: -self.keep]:
            path, fs = self._file("manifests", f"v={v:012d}.json")
            fs.delete(path, False)
        for name in self._names("data"):
            if name not in named:
                path, fs = self._file("data", name)
                fs.delete(path, True)

    # --- rows ----------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table as of a version; ``only`` some of its buckets."""
        manifest = self.manifest(version)
        folders = [f for b, f in manifest["folders"].items() if only is None or int(b) in only]
        schema = StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _written(self, rows: DataFrame, version: int) -> dict[str, str]:
        name = f"v={version}-{uuid.uuid4().hex[:12]}"
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return {n.split("=")[1]: f"{name}/{n}" for n in self._names(f"data/{name}") if n.startswith("_bucket=")}

    def create(self, rows: DataFrame) -> None:
        """Version 0; nothing if the table is there already."""
        if not self.versions():
            self._commit({"version": 0, "mark": "", "schema": rows.schema.jsonValue(), "folders": self._written(rows, 0)})

    def committed(self, mark: str) -> bool:
        return any(self.manifest(v)["mark"] == mark for v in self.versions())

    def update(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], mark: str) -> int:
        """Replace the touched buckets by ``merge(old rows, new rows)`` of the same columns. Returns the newest version.

        ``rows`` are read more than once: checkpoint them if they are dear to compute."""
        newest = self.manifest()
        if self.committed(mark):
            return newest["version"]
        touched = [r[0] for r in rows.select(self.bucket()).distinct().collect()]
        if not touched:
            return newest["version"]
        old = self.read(only=touched)
        merged = merge(old, rows).select(old.columns)
        version = newest["version"] + 1
        folders = {b: f for b, f in newest["folders"].items() if int(b) not in touched}
        self._commit({**newest, "version": version, "mark": mark, "folders": {**folders, **self._written(merged, version)}})
        self._clean()
        return version


def batch_mark(batch: DataFrame, batch_id: int) -> str:
    """Names a micro-batch over restarts: a streaming query's id is kept in its checkpoint."""
    return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
