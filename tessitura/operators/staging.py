"""Results that several later steps read, computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names. Where that is unset: a temporary one if driver and executors are one process,
    else an error, as there is no other place that all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{what} needs spark.checkpoint.dir: a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root}/{what}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str, each: int = 1 << 20) -> DataFrame:
    """The rows of tables dealt out by ``keys``: a partition for each ``each`` bytes of the files that are read, and one for each core at least. So more input
    makes more tasks, not larger ones: left to itself, Spark fills tasks up to a size in shuffled bytes, which are many times that in sorts and lists."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each)), *keys)


def staged(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there, so that a lost executor costs no recomputation of what stands before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()
