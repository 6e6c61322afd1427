"""Sources: pitch contours, tonics, sections, library tables, WAV windows. All read through Spark, so any store that it reads will do.

Contours, tonics and sections stand in a file of each record, or packed: many records in few files, as a store of a file a record costs milliseconds for each."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: What can't stand in a packed line, and what stands for it; read back in this order.
_ESCAPES = [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\\", "\\s")]


def pack(texts: DataFrame, path: str) -> None:
    """Writes texts (file, value) to a folder of packed files: a line of each row, the name of its file, a tab and the text. Null texts are empty."""
    def escaped(c: Column) -> Column:
        for a, b in reversed(_ESCAPES):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    texts.select(F.concat(escaped(F.col("file")), F.lit("\t"), escaped(F.coalesce("value", F.lit("")))).alias("value")).write.text(path)


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """The rows (file, value) that ``pack`` wrote."""
    def plain(c: Column) -> Column:
        for a, b in _ESCAPES:
            c = F.replace(c, F.lit(b), F.lit(a))
        return c

    d = spark.read.text(path)
    return d.select(plain(F.substring_index("value", "\t", 1)).alias("file"), plain(F.substring_index("value", "\t", -1)).alias("value"))


def _lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    if packed:
        return unpacked(spark, path)
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def read_contour(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(file, t_s, hz): lines of two numbers or more; others are dropped; hz of 0 or less is 0 (unvoiced). packed: of files that ``pack`` wrote, a row a line."""
    parts = F.split(F.trim("value"), r"[\t, ]+")
    d = _lines(spark, path, packed).select("file", F.get(parts, F.lit(0)).try_cast("double").alias("t_s"), F.get(parts, F.lit(1)).try_cast("double").alias("hz"))
    return d.filter("t_s is not null and hz is not null and not isnan(t_s) and not isnan(hz)").withColumn("hz", F.greatest("hz", F.lit(0.0)))


def read_tonic(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(file, tonic_hz): the first token of each file if it is a positive number, else null. packed: of files that ``pack`` wrote, a row a whole text."""
    whole = unpacked(spark, path) if packed else spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    d = whole.select("file", F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).try_cast("double").alias("x"))
    return d.select("file", F.when(F.col("x") > 0, F.col("x")).alias("tonic_hz"))


def read_sections(spark: SparkSession, path: str, columns: int = 3, packed: bool = False) -> DataFrame:
    """(file, start_s, end_s, label): start, end, label; or with four columns start, flag, duration, label. Rows without a start are dropped. packed: of files
    that ``pack`` wrote, a row a line."""
    p = F.split(F.trim("value"), r"\t| {2,}")
    num = lambda k: F.get(p, F.lit(k)).try_cast("double")
    end = num(1) if columns == 3 else num(0) + num(2)
    return _lines(spark, path, packed).select("file", num(0).alias("start_s"), end.alias("end_s"), F.get(p, F.lit(columns - 1)).alias("label")).filter("start_s is not null").orderBy("file", "start_s")


def list_records(spark: SparkSession, path: str, suffixes: dict[str, str]) -> DataFrame:
    """One row for each directory and base name: the file with each suffix, null where there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    kind, base = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, suffix in suffixes.items():
        hit = F.col("path").endswith(suffix)
        kind, base = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, F.expr(f"left(path, length(path) - {len(suffix)})")).otherwise(base)
    return files.withColumn("kind", kind).withColumn("base", base).filter("kind is not null").groupBy("base").agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in suffixes])


def wikitable_rows(lines: DataFrame, by: str, order: str, value: str = "value") -> DataFrame:
    """Cells of rows of "||"-separated lines, with the last heading ("== x ==") carried down."""
    heading = F.nullif(F.regexp_extract(value, r"^==+\s*(.*?)\s*==+$", 1), F.lit(""))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("heading", F.last(heading, True).over(w)).filter(F.col(value).startswith("|") & F.col(value).contains("||"))
    return d.select(by, order, "heading", F.transform(F.split(F.regexp_replace(value, r"^\|\s*", ""), r"\s*\|\|\s*"), lambda x: F.trim(x)).alias("cells"))


def decode_wav(data: bytes, start_s: float = 0.0, length_s: float | None = None) -> tuple[int, np.ndarray]:
    """(rate, mono samples) of a window of a RIFF file: PCM of 8, 16, 24 or 32 bits, or floats; channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF file")
    at, fmt, body = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
            kind = struct.unpack_from("<H", data, at + 32)[0] if fmt[0] == 0xFFFE else fmt[0]
        elif name == b"data":
            # Streamed files leave the size open: the rest is data.
            body = data[at + 8 :] if size in (0, 0xFFFFFFFF) else data[at + 8 : at + 8 + size]
            break
        at += 8 + size + size % 2
    if fmt is None:
        raise ValueError("no format")
    _, channels, rate, _, block, bits = fmt
    a = int(start_s * rate)
    b = len(body) // block if length_s is None else min(len(body) // block, a + int(length_s * rate))
    body = body[a * block : max(a, b) * block]
    if kind == 3:
        x = np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 2.0**23
    else:
        x = np.frombuffer(body, f"<i{bits // 8}").astype(float) / 2.0 ** (bits - 1)
    return rate, x.reshape(-1, channels).mean(1)


def read_wav(spark: SparkSession, path: str, start_s: float = 0.0, length_s: float | None = None) -> DataFrame:
    """(file, sr, pcm, error): a broken file gives its error instead of ending the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    rate, x = decode_wav(bytes(content), start_s, length_s)
                    rows.append((p, rate, x, None))
                except (ValueError, struct.error) as e:
                    rows.append((p, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "sr", "pcm", "error"]).astype({"sr": "Int64"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(run, "file string, sr long, pcm array<double>, error string")
