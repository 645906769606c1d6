"""Tables of which an update rewrites only the buckets that it touches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import _found
from .documents import upsert
from .staged import staged

MANIFEST = "bucket int, path string"


@dataclass(frozen=True)
class BucketedTable:
    """A table in ``buckets`` folders by a hash of its key. A version is a manifest, one row a bucket, that names the folder of each; a new version writes the
    touched buckets beside the old ones and then its manifest, in one file, by which all of it is there or nothing. Readers keep what they have begun to read.

    ``schema`` names the columns but created and updated, which upserts manage.
    """

    folder: str
    schema: str
    key: str = "id"
    buckets: int = 256

    def _columns(self) -> str:
        return f"{self.schema}, created timestamp, updated timestamp"

    def _manifest(self, spark: SparkSession) -> tuple[int, dict[int, str]]:
        """The newest version and its buckets' folders: a row a bucket, ``buckets`` at most."""
        versions = _found(spark, f"{self.folder}/manifest", f"{MANIFEST}, version int")
        newest = versions.agg(F.max("version")).first()[0] if versions is not None else None
        if newest is None:
            return 0, {}
        return newest, {r["bucket"]: r["path"] for r in versions.where(F.col("version") == newest).collect()}

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.schema(self._columns()).parquet(*paths) if paths else spark.createDataFrame([], self._columns())

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, sorted(self._manifest(spark)[1].values()))

    def upsert(self, updates: DataFrame, as_of, order: str | None = None) -> int:
        """The number of the version that holds ``updates`` too (see :func:`~linkloom.sources.documents.upsert`): only buckets that hold their keys are read and written. A null key gets one."""
        spark = updates.sparkSession
        columns = [c.split()[0] for c in self.schema.split(", ")]
        content = F.sha2(F.to_json(F.struct(*columns)), 256)
        kind = next(c.split()[1] for c in self.schema.split(", ") if c.split()[0] == self.key)
        named = F.coalesce(F.col(self.key).cast("string"), content) if kind == "string" else F.coalesce(F.col(self.key), F.xxhash64(content))
        fresh = staged(updates.withColumn(self.key, named).withColumn("_bucket", self._bucket()))
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())
        version, places = self._manifest(spark)
        if not touched:
            return version
        old = self._read(spark, [places[b] for b in touched if b in places])
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        merged = upsert(old, fresh.drop("_bucket"), as_of, self.key, order).withColumn("bucket", self._bucket())
        merged.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(path)
        places |= {b: f"{path}/bucket={b}" for b in touched}
        rows = spark.createDataFrame(sorted(places.items()), MANIFEST)
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifest/version={version + 1}")
        return version + 1
