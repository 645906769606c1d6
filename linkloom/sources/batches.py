"""Tables that micro-batches write, so that a batch that runs again changes nothing, and the state of batches that are at work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class BatchTable:
    """A table with a folder for each batch. Writing a batch again replaces its folder; a batch reads what came :meth:`before` it, never what an earlier try of its own has left."""

    folder: str
    schema: str

    def put(self, df: DataFrame, batch_id: int) -> None:
        columns = [c.split()[0] for c in self.schema.split(", ")]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with batch."""
        found = _found(spark, self.folder, f"{self.schema}, batch long")
        return spark.createDataFrame([], f"{self.schema}, batch long") if found is None else found

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.read(spark).where(F.col("batch") < batch_id).drop("batch")


@dataclass(frozen=True)
class StateTable:
    """Messages that are at work, a folder for each batch: stored before the work, emptied after it. An empty folder says that a batch is done, so that it isn't
    worked on again if it comes back; folders of older batches go."""

    folder: str
    schema: str

    def _batch(self, batch_id: int) -> str:
        return f"{self.folder}/batch={batch_id}"

    def store(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """The messages as stored: what a batch works on is what a restart would find."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        messages.select(*columns).write.mode("overwrite").parquet(self._batch(batch_id))
        return self.rows(messages.sparkSession, batch_id)

    def rows(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self._batch(batch_id))

    def clear(self, spark: SparkSession, batch_id: int) -> None:
        spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self._batch(batch_id))
        delete_folder(spark, self._batch(batch_id - 2))

    def is_done(self, spark: SparkSession, batch_id: int) -> bool:
        found = _found(spark, self._batch(batch_id), self.schema)
        return found is not None and found.isEmpty()

    def outstanding(self, spark: SparkSession) -> list[int]:
        """Batches with stored messages, in order: at most the few that no run has finished."""
        found = _found(spark, self.folder, f"{self.schema}, batch long")
        return [] if found is None else sorted(r["batch"] for r in found.select("batch").distinct().collect())
