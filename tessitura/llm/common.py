"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, so that the result does not depend on a locale."""
    return F.translate(c, UPPER, UPPER.lower())


def whole_text(c: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(c), F.lit(""))


def two_hashes(c: Column, name: str = "__h") -> list[Column]:
    """128 bits as two longs: xxHash under two seeds."""
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit("second"), c).alias(f"{name}2")]


def text_ids(c: Column, name: str = "__h") -> list[Column]:
    """128 bits as two longs by which equal texts are told: of a cryptographic digest, as nobody can make two texts meet there."""
    return two_hashes(F.sha2(c, 256), name)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder of its own under the shared one that spark.checkpoint.dir names. Where that is unset, a temporary one if driver and executors are
    one process, else an error: there is no other place that all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{what} needs spark.checkpoint.dir: a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root}/{what}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame, forget: bool = False) -> DataFrame:
    """The rows written to the shared folder in spark.checkpoint.dir and read from there, so that lost executors don't matter.

    What was shuffled on the way isn't read again. Spark removes it once the driver has forgotten it, so with ``forget`` the driver is told to collect its
    garbage, Python's first, as that holds on to the JVM's; else the files of all steps of a long job would stay on the executors' disks until its heap
    happened to fill. A plan that the caller has given a name is held by that name; one that is handed over without goes at once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    out = df.checkpoint()
    if forget:
        del df
        gc.collect()
        context._jvm.System.gc()
    return out
