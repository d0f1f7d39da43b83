"""Tables that streams are merged into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class FoldedTable:
    """A keyed table of Parquet files in the shared folder; each micro-batch is folded into it once.

    Rows lie in buckets of keys.  A batch writes a new version of the buckets that it touches, the others stay as they
    are, and then one row per touched bucket into the ledger beside them, which makes the version count.  A batch that
    the ledger has is passed over, one that failed before is written over: run again after a failure, from a
    checkpoint or in another job, a batch changes nothing.  Readers take of each bucket the newest version of the ledger, and
    so never see half a batch.

    ``fold`` gives for each column that is no key the aggregate over the old row and the new ones, such as
    ``F.sum("n")`` or ``F.max("last")``; it is summed up by the tasks that read a batch before a key's rows meet.
    Rows with null keys are keys like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], fold: dict[str, Column], buckets: int = 64):
        self.rows, self.ledger, self.keys, self.fold, self.buckets = f"{folder}/rows", f"{folder}/ledger", keys, fold, buckets
        self.columns = [*keys, *fold]
        self.schema = StructType([schema[c] for c in self.columns])
        named = spark.createDataFrame([], StructType(self.schema.fields)).select("*", F.lit(0).alias("version"), F.lit(0).alias("bucket"))
        self.stored = named.schema
        named.limit(0).write.mode("append").partitionBy("version", "bucket").parquet(self.rows)
        named.limit(0).select("bucket", "version").write.mode("append").partitionBy("version").parquet(self.ledger)

    def _merged(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("bucket int, version int").parquet(self.ledger)

    def current(self, spark: SparkSession) -> DataFrame:
        """The table as of the last whole batch."""
        return self._stored(spark).select(*self.columns)

    def _stored(self, spark: SparkSession) -> DataFrame:
        newest = self._merged(spark).groupBy("bucket").agg(F.max("version").alias("version"))
        return spark.read.schema(self.stored).parquet(self.rows).join(F.broadcast(newest), ["bucket", "version"])  # a row a bucket

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Fold the rows of a micro-batch in, unless that was done before."""
        spark = batch.sparkSession
        if self._merged(spark).where(F.col("version") == batch_id).limit(1).count():
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.columns).groupBy(*self.keys).agg(*[how.alias(c) for c, how in self.fold.items()]).withColumn("bucket", bucket)
        touched = new.select("bucket").distinct()
        old = self._stored(spark).join(F.broadcast(touched), "bucket").select(*self.columns, "bucket")
        both = old.unionByName(new).groupBy(*self.keys, "bucket").agg(*[how.alias(c) for c, how in self.fold.items()])
        write = lambda df, at, *by: df.withColumn("version", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(at)
        write(both.select(*self.columns, "bucket"), self.rows, "version", "bucket")
        write(touched.coalesce(1), self.ledger, "version")  # one small file: it is there or it is not


def fold_stream(stream: DataFrame, table: FoldedTable, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Fold everything that is there by now into the table, a micro-batch after the other; ``on_batch`` runs after each."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id)
        if on_batch is not None:
            on_batch(batch, batch_id)

    stream.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
