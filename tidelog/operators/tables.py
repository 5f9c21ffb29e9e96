"""Managed tables: a folder of Parquet files for each version, with modes error, overwrite and append.

A write adds a folder and then, as its last step, the next manifest, through the file system that the
path names; readers take the highest manifest. Append merges the schemas first, so files of old versions
stay as they are and are projected to the merged schema when read."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidelog.errors import TableExists, TableNotFound
from tidelog.operators.evolution import compare_schemas, project


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def tables(self) -> list[str]:
        return [n.removesuffix(".tbl") for n in self._names(self.root) if n.endswith(".tbl")]

    def _manifest(self, name: str) -> dict | None:
        found = [n for n in self._names(f"{self.root}/{name}.tbl/manifests") if n.endswith(".json")]
        if not found:
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}.tbl/manifests/{found[-1]}").collect()))

    def write(self, name: str, df: DataFrame, mode: str = "error") -> int:
        """Returns the new version."""
        old = self._manifest(name)
        if old and mode == "error":
            raise TableExists(name)
        schema = df.schema
        if old and mode == "append":
            schema = compare_schemas(T.StructType.fromJson(old["schema"]), df.schema).merged
            df = project(df, schema)
        return self._put(name, df, schema, old, [] if mode == "overwrite" or not old else old["parts"])

    def _put(self, name: str, df: DataFrame, schema: T.StructType, old: dict | None, kept: list) -> int:
        folder = f"{self.root}/{name}.tbl/data-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        version = (old["version"] if old else 0) + 1
        manifest = {"version": version, "schema": schema.jsonValue(), "parts": [*kept, [folder, df.schema.jsonValue()]]}
        p, fs = self._fs(f"{self.root}/{name}.tbl/manifests/{version:012d}.json")
        out = fs.create(p, False)  # a second writer of this version fails here
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return version

    def read(self, name: str) -> DataFrame:
        """All parts, those of one schema by one scan."""
        manifest = self._manifest(name)
        if manifest is None:
            raise TableNotFound(name)
        schema = T.StructType.fromJson(manifest["schema"])
        folders: dict[str, list[str]] = {}
        for folder, own in manifest["parts"]:
            folders.setdefault(json.dumps(own), []).append(folder)
        frames = [project(self.spark.read.schema(T.StructType.fromJson(json.loads(own))).parquet(*paths), schema) for own, paths in folders.items()]
        return reduce(DataFrame.unionByName, frames)

    def compact(self, name: str) -> int:
        """The next version, with all rows in one folder of the present schema."""
        df = self.read(name)
        return self._put(name, df, df.schema, self._manifest(name), [])

    def register_views(self) -> list[str]:
        for n in self.tables():
            self.read(n).createOrReplaceTempView(n)
        return self.tables()
