"""Frames that several parts of a query share, written once to the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of the session (`spark.checkpoint.dir`). Where it is unset, a local session (one machine, as
    in tests) gets a temporary folder of its own; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[context.applicationId]


#: Rows of a task of `spread`, and the fewest for which a task is worth starting.
TASK_ROWS, LEAST_ROWS = 150_000, 2_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, of about so many rows, dealt by its keys to three tasks a core and to more where those would be large. Adaptive
    execution would join them to one task a core and a few over, which then run alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(min(3 * cores, rows // LEAST_ROWS), rows // TASK_ROWS, 1)
    return df.repartition(n, *keys)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends in files that outlive any executor, and plans
    built on it start from a scan."""
    path = f"{scratch_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    # doubles that hardly repeat: dictionaries cost more than all else of writing them
    writer = df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
