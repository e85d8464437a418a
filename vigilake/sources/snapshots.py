"""Stored tables with snapshots: Parquet parts by buckets of the key, and a manifest for each version that names the parts it consists of.

A change writes new parts for the buckets it touches and then the next manifest, which must not exist yet: of two changes that began at
one version, the second fails and writes nothing that a reader sees. Older manifests stay, so any version can be read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another change took the version first."""


@dataclass(frozen=True)
class Snapshots:
    """A table below path, of rows with different keys."""

    spark: SparkSession
    path: str

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The last version, -1 without a table."""
        system, folder = self._file("manifests")
        if not system.exists(folder):
            return -1
        return max((int(f.getPath().getName().removesuffix(".json")) for f in system.listStatus(folder) if f.getPath().getName().endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        at = self.version() if version is None else version
        system, file = self._file(f"manifests/{at:010d}.json")
        stream = system.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: int, manifest: dict) -> int:
        """The manifest written beside its place and renamed into it, which fails if it is taken."""
        system, draft = self._file(f"manifests/{uuid.uuid4().hex}.draft")
        _, place = self._file(f"manifests/{base + 1:010d}.json")
        system.mkdirs(draft.getParent())
        stream = system.create(draft, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, place, options)
        except Exception as e:
            system.delete(draft, False)
            if system.exists(place):
                raise Conflict(f"version {base + 1} is taken") from e
            raise
        return base + 1

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _parts(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Writes rows by bucket; gives the folder of each bucket that has any."""
        name = f"parts/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket(keys, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        system, folder = self._file(name)
        found = [f.getPath().getName() for f in system.listStatus(folder)]
        return {f.removeprefix("__bucket="): f"{name}/{f}" for f in found if f.startswith("__bucket=")}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> int:
        """Version 0. Keys must not be null or repeat."""
        return self._commit(-1, {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "parts": self._parts(rows, keys, buckets)})

    def _read(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{p}" for b, p in sorted(manifest["parts"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless told."""
        return self._read(self.manifest(version))

    def merge(self, changes: DataFrame, matched: dict[str, Column] | None = None, insert: bool = True, base: int | None = None) -> int:
        """The next version: rows of changes are inserted, or their columns take the place of those of the row with equal keys.

        matched gives values for rows with equal keys instead, by column, of F.col("old.c") and F.col("new.c"); columns it leaves out keep theirs. insert=False
        passes over rows without a match. changes has one row a key. Only buckets with changed keys are read and written. base is the version that the change was
        made for, the last one unless told; a later one is a conflict.
        """
        at = self.version() if base is None else base
        manifest = self.manifest(at)
        keys, buckets, names = manifest["keys"], manifest["buckets"], [f["name"] for f in manifest["schema"]["fields"]]
        new = changes.select(*names)
        touched = {str(r[0]) for r in new.select(self._bucket(keys, buckets)).distinct().collect()}  # at most the number of buckets
        if not touched:
            return at
        old = self._read(manifest, touched).alias("old")
        same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
        both = old.join(new.alias("new"), same, "full" if insert else "left")
        met = F.col(f"old.{keys[0]}").isNotNull() & F.col(f"new.{keys[0]}").isNotNull()
        values = matched if matched is not None else {c: F.col(f"new.{c}") for c in names}
        out = [F.when(met, values.get(c, F.col(f"old.{c}"))).when(F.col(f"old.{keys[0]}").isNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in names]
        parts = self._parts(both.select(*out), keys, buckets)
        return self._commit(at, manifest | {"parts": {b: p for b, p in manifest["parts"].items() if b not in touched} | parts})
