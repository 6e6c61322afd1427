"""Operators over notation cells, sections and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extension_hold(cells: DataFrame, by: str, order: str, is_hold: Column, beats: Column) -> DataFrame:
    """(by, n, start, beats): cells that hold add their beats to the cell before them; holds before the first cell are dropped."""
    w = Window.partitionBy(by).orderBy(order)
    d = cells.withColumn("n", F.sum(F.when(is_hold, 0).otherwise(1)).over(w)).withColumn("__beats", beats).filter("n > 0")
    return d.groupBy(by, "n").agg(F.min(order).alias("start"), F.sum("__beats").alias("beats"))


def segments(cells: DataFrame, by: str, order: str, is_bar: Column, beats: Column) -> DataFrame:
    """(by, segment, beats): sums between bars; empty ones go, a trailing part stays."""
    w = Window.partitionBy(by).orderBy(order)
    d = cells.withColumn("segment", F.sum(F.when(is_bar, 1).otherwise(0)).over(w)).withColumn("__b", F.when(is_bar, F.lit(0.0)).otherwise(beats))
    return d.groupBy(by, "segment").agg(F.sum("__b").alias("beats")).filter("beats > 0")


def join_lines(cells: DataFrame, by: str, line: str, order: str, kind: str) -> DataFrame:
    """Cells of all lines in one row of cells; a bar is put between two lines unless one of them has it there already."""
    w = Window.partitionBy(by).orderBy(line, order)
    turned = (F.col(line) != F.lag(line).over(w)) & (F.col(kind) != "bar") & (F.lag(kind).over(w) != "bar")
    d = cells.withColumn("__t", F.coalesce(turned, F.lit(False)))
    d = d.withColumn("__k", F.explode(F.when(F.col("__t"), F.array(F.lit("bar"), F.lit("own"))).otherwise(F.array(F.lit("own")))))
    place = F.row_number().over(Window.partitionBy(by).orderBy(line, order, "__k")).cast("long")
    return d.select(by, place.alias("n"), F.when(F.col("__k") == "bar", "bar").otherwise(F.col(kind)).alias(kind))


def chunk_lines(cells: DataFrame, by: str, order: str, is_bar: Column, width: int = 8) -> DataFrame:
    """line: a new one at each bar."""
    return cells.withColumn("line", F.sum(is_bar.cast("int")).over(Window.partitionBy(by).orderBy(order)))


def point_lookup(points: DataFrame, spans: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Adds ``value`` of the span (by, start_s, end_s; half open, not overlapping) that holds the point; null outside. One sort, no pairs."""
    span = F.struct(F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.col(value).alias("v"))
    both = points.withColumn("__s", F.lit(None).cast(spans.select(span.alias("x")).schema["x"].dataType)).withColumn("__own", F.lit(1)).unionByName(spans.select(by, F.col("start_s").alias(at), span.alias("__s"), F.lit(0).alias("__own")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__l", F.last("__s", True).over(w)).filter("__own = 1").withColumn(value, F.when(F.col(at) < F.col("__l.e"), F.col("__l.v"))).drop("__s", "__own", "__l")


def nearest_in_band(left: DataFrame, right: DataFrame, by: str, x: str, value: str, band: float) -> DataFrame:
    """Adds ``value`` of the right row nearest in ``x`` within ``band``; the left one on ties; null if there is none."""
    pair = F.struct(F.col(x).alias("x"), F.col(value).alias("v"))
    both = left.withColumn("__r", F.lit(None).cast(right.select(pair.alias("p")).schema["p"].dataType)).withColumn("__own", F.lit(1)).unionByName(right.select(by, x, pair.alias("__r"), F.lit(0).alias("__own")), allowMissingColumns=True)
    up, down = Window.partitionBy(by).orderBy(x, "__own"), Window.partitionBy(by).orderBy(F.desc(x), F.desc("__own"))
    before = Window.unboundedPreceding
    d = both.withColumn("__a", F.last("__r", True).over(up.rowsBetween(before, 0))).withColumn("__b", F.last("__r", True).over(down.rowsBetween(before, -1))).filter("__own = 1")
    da, db = F.col(x) - F.col("__a.x"), F.col("__b.x") - F.col(x)
    pick = F.when((da <= band) & (db.isNull() | (da <= db)), F.col("__a.v")).when(db <= band, F.col("__b.v"))
    return d.withColumn(value, pick).drop("__r", "__own", "__a", "__b")


def first_contained(text: Column, choices: list[str], default: str) -> Column:
    """The first of the choices that the text contains."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(c)), F.lit(c)) for c in choices], F.lit(default))


def quality_summary(notes: DataFrame, by: str) -> DataFrame:
    return notes.groupBy(by).agg(F.avg(F.abs("deviation")).alias("mean_deviation"), F.avg("conf").alias("mean_conf"), F.count("*").alias("n"))


def dbfs(values: Column) -> Column:
    """Level of 16-bit samples in dB below full scale; -999 without samples or signal."""
    rms = F.sqrt(F.avg(values * values))
    return F.coalesce(F.when(rms > 0, 20 * F.log10(rms / 32768)), F.lit(-999.0))
