"""A table in numbered versions: written whole, made visible by a manifest, never changed."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class StaleBase(ValueError):
    """Another version was written since the base was read."""


@dataclass(frozen=True)
class VersionedTable:
    """Versions 0, 1, ... of a table under `root`, in any store with Hadoop paths.

    A version's rows are written to a folder of their own first, and its manifest
    last. Creating the manifest fails where it exists already, so of two writers
    with one base one is refused, and a reader sees whole versions only. What a
    failed writer leaves behind has no manifest and is never read.
    """

    spark: SparkSession
    root: str

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        """The newest version, or none. Reads the names of the manifests."""
        folder, store = self._path("manifests")
        if not store.exists(folder):
            return None
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)

    def manifest(self, version: int) -> dict:
        path, store = self._path("manifests", f"{version:012d}.json")
        if not store.exists(path):
            raise ValueError(f"no version {version}")
        source = store.open(path)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        version = self.current() if version is None else version
        if version is None:
            raise ValueError("the table has no version yet")
        known = self.manifest(version)
        return self.spark.read.schema(known["schema"]).parquet(f"{self.root.rstrip('/')}/{known['folder']}")

    def write(self, rows: DataFrame, base: int | None) -> int:
        """The number of the new version, made from `base` (none: the first). Refused when the base is not the newest any more."""
        self._require(base)
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root.rstrip('/')}/{folder}")
        version = 0 if base is None else base + 1
        text = json.dumps({"version": version, "base": base, "folder": folder, "schema": rows.schema.toDDL()})
        path, store = self._path("manifests", f"{version:012d}.json")
        try:
            out = store.create(path, False)
        except Py4JJavaError:
            self._require(base)
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return version

    def _require(self, base: int | None) -> None:
        newest = self.current()
        if newest != base:
            raise StaleBase(f"version {base} is not the newest any more, {newest} is")
