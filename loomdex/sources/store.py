"""Tables on plain Parquet with versions: a write makes new files beside the old ones, and then a manifest that names those that are current.

A table may be cut into buckets by a key; replacing the rows of some keys then rewrites only their buckets, and the manifest goes on naming
the other buckets' files. Manifests are numbered and made exclusively, so of two writers of one version the second fails
instead of undoing the first. All files are reached by Hadoop's interface, so the folder may be on any file system that Spark can use.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.operators.upserts import delete_by, upsert
from loomdex.sources.tables import Files

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the next version of a table first."""


class Store:
    """Named tables below a folder that driver and executors share. A reader keeps its version while a writer makes the next."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2, buckets: int = BUCKETS):
        self.spark, self.folder, self.keep, self.buckets = spark, folder.rstrip("/"), keep, buckets
        self.files = Files(spark, self.folder)
        self.files.make()

    def _manifests(self, name: str) -> list[str]:
        return [x for x in self.files.names() if x.startswith(f"{name}.") and x.endswith(".json")]

    def names(self) -> list[str]:
        return sorted({x.rsplit(".", 2)[0] for x in self.files.names() if x.endswith(".json")})

    def versions(self, name: str) -> list[str]:
        """The numbers of the versions that can still be read, the current one last."""
        return [x.rsplit(".", 2)[1] for x in self._manifests(name)]

    def _manifest(self, name: str) -> dict | None:
        found = self._manifests(name)
        return json.loads(self.files.child(found[-1]).read()) if found else None

    def read(self, name: str) -> DataFrame:
        """The current version; KeyError where there is none."""
        if (manifest := self._manifest(name)) is None:
            raise KeyError(name)
        return self._read(manifest, manifest["parts"])

    def _read(self, manifest: dict, parts: list[str] | dict[str, str]) -> DataFrame:
        schema, paths = StructType.fromJson(manifest["schema"]), [f"{self.folder}/{manifest['parts'][x]}" for x in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, name: str, before: dict | None, parts: dict[str, str], schema: StructType, key: str | None) -> None:
        number = (before["number"] if before else 0) + 1
        manifest = {"number": number, "parts": parts, "schema": json.loads(schema.json()), "key": key}
        try:
            self.files.child(f"{name}.{number:010d}.json").create(json.dumps(manifest))
        except FileExistsError as e:
            raise Conflict(f"{name}, version {number}") from e
        old = self._manifests(name)[: -self.keep]
        if old:
            named = {p for x in self._manifests(name)[-self.keep :] for p in json.loads(self.files.child(x).read())["parts"].values()}
            versions = {p.split("/")[0] for p in named}
            for x in old:
                for part in set(json.loads(self.files.child(x).read())["parts"].values()) - named:
                    self.files.child(part if part.split("/")[0] in versions else part.split("/")[0]).remove()
                self.files.child(x).remove()

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _files_of(self, name: str, df: DataFrame, key: str | None) -> dict[str, str]:
        """Writes the rows and gives the folder of each bucket that has any."""
        version = f"{name}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        if key is None:
            df.write.parquet(f"{self.folder}/{version}")
            return {"": version}
        df.withColumn("__bucket", self._bucket(key)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{version}")
        found = {x.removeprefix("__bucket="): f"{version}/{x}" for x in self.files.child(version).names() if x.startswith("__bucket=")}
        if not found:
            self.files.child(version).remove()
        return found

    def write(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Makes df the whole table, cut into buckets by ``key`` if one is given. Rows with a null key are a bucket's too."""
        before = self._manifest(name)
        self._commit(name, before, self._files_of(name, df, key), df.schema, key)

    def replace(self, name: str, rows: DataFrame, keys: DataFrame, key: str) -> int:
        """Puts ``rows`` in the place of all rows whose key is in ``keys``; only the buckets of these keys are read and written. Their number is given back."""
        before = self._manifest(name)
        if before is None or before["key"] != key:
            self.write(name, rows if before is None else delete_by(self.read(name), keys, key).unionByName(rows), key)
            return self.buckets
        touched = sorted(str(r[0]) for r in keys.select(self._bucket(key).alias("b")).distinct().collect())  # as many as there are buckets at most
        if not touched:
            return 0
        old = self._read(before, [x for x in touched if x in before["parts"]])
        parts = {k: v for k, v in before["parts"].items() if k not in touched} | self._files_of(name, delete_by(old, keys, key).unionByName(rows.select(*old.columns)), key)
        self._commit(name, before, parts, old.schema, key)
        return len(touched)

    def upsert(self, name: str, rows: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",)) -> None:
        self.write(name, upsert(self.read(name), rows, key, tuple(c for c in kept if c in rows.columns)) if self.versions(name) else rows)

    def delete(self, name: str, gone: DataFrame, key: str, gone_key: str | None = None) -> None:
        if self.versions(name):
            self.write(name, delete_by(self.read(name), gone, key, gone_key))

    def drop(self, name: str) -> None:
        for x in self._manifests(name):
            for version in {part.split("/")[0] for part in json.loads(self.files.child(x).read())["parts"].values()}:
                self.files.child(version).remove()
            self.files.child(x).remove()
