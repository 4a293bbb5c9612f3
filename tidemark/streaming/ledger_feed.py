"""Observations arriving as a stream: appended as they are and rebuilt at each read, or merged into a kept ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.ingest import KEY, ledger, ledger_append
from tidemark.sources.scratch import written

#: Buckets of a kept ledger; a batch rewrites those that its keys fall in.
BUCKETS = 64


def append_observations(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch of observations to `path`; the checkpoint makes a restart continue, not repeat."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_ledger(spark: SparkSession, path: str, payload: list[str]) -> DataFrame:
    """Ledger of everything appended so far; late rows take their place by arrival time."""
    return ledger(spark.read.parquet(path), payload)


def _table(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(f"{path}-schema").schema.fields
    return spark.read.schema(StructType([*fields, StructField("bucket", IntegerType())])).parquet(path)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def create_kept_ledger(spark: SparkSession, path: str, observations: StructType, payload: list[str]) -> None:
    """An empty kept ledger for observations of this schema."""
    none = ledger(spark.createDataFrame([], observations), payload)
    none.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").mode("overwrite").parquet(path)
    none.write.mode("overwrite").parquet(f"{path}-schema")


def kept_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a kept ledger."""
    return _table(spark, path).drop("bucket")


def merge_batch(spark: SparkSession, batch: DataFrame, path: str, payload: list[str], buckets: int = BUCKETS) -> None:
    """Append one batch of observations to a kept ledger. Only the buckets of the batch's keys are read and written anew,
    and in them only its keys are merged. Merging a batch again changes nothing, so a batch that was broken off is
    simply repeated."""
    batch = written(batch, "batch")
    touched = [r[0] for r in batch.select(_bucket(buckets).alias("b")).distinct().collect()]  # a number a bucket
    if not touched:
        return
    here = _table(spark, path).filter(F.col("bucket").isin(touched)).drop("bucket")
    rest = here.join(batch.select(*KEY).distinct(), [*KEY], "left_anti")
    after = rest.unionByName(ledger_append(here, batch, payload)).withColumn("bucket", _bucket(buckets))
    # a table is not overwritten from itself
    after = written(after, "merged").repartition("bucket")
    after.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def merge_observations(stream: DataFrame, path: str, payload: list[str], checkpoint: str, buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Merge each micro-batch of observations into the kept ledger at `path`."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: merge_batch(batch.sparkSession, batch, path, payload, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
