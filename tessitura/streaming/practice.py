"""Streams of frames: hopping aggregates, phrases as sessions, and a causal stabiliser with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessitura.operators.staging import shared_folder


def _drained(spark: SparkSession, out: DataFrame) -> DataFrame:
    """Runs a stream over what is there and reads what it wrote, under the session's shared folder."""
    root = shared_folder(spark, "stream")
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hop_aggregates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", hop: str = "15 minutes") -> DataFrame:
    """Counts and means by hopping window and type; a window comes out when the watermark has passed it, later rows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, hop), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Phrases: a user's events less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def stream_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, hop_aggregates(read_events(spark, sf_dir))).withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sessions(read_events(spark, sf_dir))).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def stabilise(cents: np.ndarray, t: np.ndarray, held: float | None = None, since: float = 0.0, slip_s: float = 0.1) -> tuple[np.ndarray, float | None, float]:
    """Octave slips of up to ``slip_s`` are folded to what is held; a leap that lasts longer is kept. Returns the contour and the state after it."""
    out = np.empty(len(cents))
    for i, (c, now) in enumerate(zip(cents, t)):
        if held is not None and abs(abs(c - held) - 1200) < 260:
            if since == 0.0:
                since = now
            if now - since <= slip_s:
                out[i] = c - 1200 if c > held else c + 1200
                continue
        held, since, out[i] = c, 0.0, c
    return out, held, since


def stabilised(frames: DataFrame) -> DataFrame:
    """The stabiliser over a stream of (clip_id, t_s, cents): its state is two numbers a clip, so it survives a lost executor with the stream's checkpoint."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values("t_s")
        out, held, since = stabilise(rows["cents"].to_numpy(), rows["t_s"].to_numpy(), held, since)
        state.update((held, since))
        yield pd.DataFrame({"clip_id": key[0], "t_s": rows["t_s"].to_numpy(), "cents": out})

    return frames.groupBy("clip_id").applyInPandasWithState(run, "clip_id long, t_s double, cents double", "held double, since double", "append", GroupStateTimeout.NoTimeout)


def stream_stabilised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of frames in cents, stabilised. All files are one batch here, so each clip's frames come in order."""
    cents = read_events(spark, sf_dir).select(F.col("user_id").cast("long").alias("clip_id"), (F.col("ts").cast("double") - 1.7e9).alias("t_s"), (1200 * F.log2(F.greatest("value", F.lit(0.01)) / 55)).alias("cents"))
    return _drained(spark, stabilised(cents))
