"""Audits of notation and of practice, glyphs that belong together, and lyrics that belong to svaras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.staging import dealt

EPS = 1e-6


def marks_on_angas(segments: Column, angas: Column) -> Column:
    """Whether, at speed 1, 2 or 4 and with or without a pickup, the beats are whole cycles and every inner boundary of an anga is where a segment ends.

    segments, angas: arrays of beats; both are short."""
    add = lambda t, x: t + x
    zero = F.lit(0.0)
    total, beats = F.aggregate(segments, zero, add), F.aggregate(angas, zero, lambda t, x: t + x.cast("double"))
    marks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda k: F.round(F.aggregate(F.slice(segments, 1, k), zero, add), 6))
    marks = F.when(F.size(segments) > 1, marks).otherwise(F.array().cast("array<double>"))
    ends = F.transform(F.sequence(F.lit(1), F.size(angas)), lambda k: F.aggregate(F.slice(angas, 1, k), zero, lambda t, x: t + x.cast("double")))

    def fits(k: int, pickup: bool) -> Column:
        cycle, lead = beats * k, F.get(segments, F.lit(0))
        off = cycle - lead if pickup else zero
        q = (total + off) / cycle
        whole = (F.abs(q - F.floor(q + 0.5)) <= EPS) & (F.floor(q + 0.5) >= 1)
        want = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(q + 0.5).cast("int") - 1, F.lit(0))), lambda c: F.transform(ends, lambda e: F.round(c * cycle + e * k - off, 6))))
        inner = F.filter(want, lambda x: (x > EPS) & (x < total - EPS))
        return F.coalesce(whole & (F.size(inner) > 0) & (F.size(F.array_except(inner, marks)) == 0) & ((lead < cycle) if pickup else F.lit(True)), F.lit(False))

    tests = [fits(k, p) for k in (1, 2, 4) for p in (False, True)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return (total > 0) & out


def kalai(sections: DataFrame, by: str, beats: str, cycle: Column) -> DataFrame:
    """(by, kalai): the least of 1, 2 and 4 at which all sections are whole cycles, else 1."""
    whole = lambda k: F.bool_and((F.abs(F.col(beats) / (cycle * k) - F.floor(F.col(beats) / (cycle * k) + 0.5)) < EPS) & (F.floor(F.col(beats) / (cycle * k) + 0.5) >= 1))
    d = sections.groupBy(by).agg(*[whole(k).alias(f"k{k}") for k in (1, 2, 4)])
    return d.select(by, F.when(F.col("k1"), 1).when(F.col("k2"), 2).when(F.col("k4"), 4).otherwise(1).alias("kalai"))


def audit(sections: DataFrame, piece: str, family: str) -> DataFrame:
    """(family, pieces, clean, sections, ok): how many sections are ``ok``, and how many pieces in all their sections."""
    by = sections.groupBy(family, piece).agg(F.bool_and("ok").alias("clean"), F.count("*").alias("n"), F.count_if("ok").alias("good"))
    return by.groupBy(family).agg(F.count("*").alias("pieces"), F.count_if("clean").alias("clean"), F.sum("n").alias("sections"), F.sum("good").alias("ok"))


def hot_pages(misses: DataFrame, page: str, miss: str, least: int = 4) -> DataFrame:
    """(page, miss, n): pages where one miss stands ``least`` times or more."""
    return misses.groupBy(page, miss).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def practice_report(targets: DataFrame, by: str, tonic_hz: float) -> DataFrame:
    """(by, targets, hits, percent, typical, lean, silent, suggested_hz) of judged targets (by, verdict, dev: their median deviation, null if silent): the share of
    clean hits of all, the median of what is off, on which side, and the tonic that would take the lean away."""
    d = targets.groupBy(by).agg(F.count("*").alias("targets"), F.count_if(F.col("verdict") == "hit").alias("hits"), F.median(F.abs("dev")).alias("typical"), F.median("dev").alias("lean"), F.count_if(F.col("verdict") == "none").alias("silent"))
    return d.withColumn("percent", F.floor(100 * F.col("hits") / F.col("targets") + 0.5).cast("int")).withColumn("suggested_hz", tonic_hz * F.pow(F.lit(2.0), F.col("lean") / 1200))


def attach_marks(marks: DataFrame, bases: DataFrame, page: str, height: float = 1.4, reach: float = 1.6) -> DataFrame:
    """Adds base to marks (page, id, x, y, size): of the base glyphs (page, id, x, y, w, size) of its page at most ``height`` sizes up or down the nearest in x, if
    nearer than ``reach`` sizes of its own; the smaller id on ties. Marks and bases meet by bands of y, each base in the bands that it may serve."""
    tall = bases.agg(F.max("size")).first()[0] or 1.0
    most = max(float(marks.agg(F.max("size")).first()[0] or 1.0), float(tall)) * height
    band = lambda y: F.floor(y / most)
    near = bases.select(page, F.col("id").alias("base"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("size").alias("bs"), F.explode(F.sequence(band(F.col("y")) - 1, band(F.col("y")) + 1)).alias("band"))
    j = marks.withColumn("band", band(F.col("y"))).join(near, [page, "band"]).filter(F.abs(F.col("by") - F.col("y")) <= F.col("size") * height)
    dx = F.abs(F.col("bx") + F.col("bw") / 2 - F.col("x"))
    best = j.groupBy(page, "id").agg(F.min(F.struct(dx.alias("dx"), "base", "bs")).alias("m")).filter(F.col("m.dx") < F.col("m.bs") * reach)
    return marks.join(best.select(page, "id", F.col("m.base").alias("base")), [page, "id"], "left")


def nearest_band(points: DataFrame, bands: DataFrame, by: str, most: float = 12.0) -> DataFrame:
    """Adds band to points (by, id, y): the band (by, band, low, high; not overlapping) that holds y or is nearest, less than ``most`` away; the lower on ties.

    The band above is looked up in falling order: a frame that ends with its partition would be read anew for each row."""
    pair = F.struct(F.col("band").alias("b"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    both = points.withColumn("__b", F.lit(None).cast(bands.select(pair.alias("x")).schema["x"].dataType)).withColumn("__own", F.lit(1)).unionByName(bands.select(by, F.col("low").alias("y"), pair.alias("__b"), F.lit(0).alias("__own")), allowMissingColumns=True)
    up, down = Window.partitionBy(by).orderBy("y", "__own"), Window.partitionBy(by).orderBy(F.desc("y"), F.desc("__own"))
    before = Window.unboundedPreceding
    d = dealt(both, by).withColumn("__p", F.last("__b", True).over(up.rowsBetween(before, 0))).withColumn("__n", F.last("__b", True).over(down.rowsBetween(before, -1))).filter("__own = 1")
    before, after = F.when(F.col("__p.hi").isNotNull(), F.greatest(F.lit(0.0), F.col("y") - F.col("__p.hi"))), F.col("__n.lo") - F.col("y")
    pick = F.when((before < most) & (after.isNull() | (before <= after)), F.col("__p.b")).when(after < most, F.col("__n.b"))
    return d.withColumn("band", pick).drop("__b", "__own", "__p", "__n")


def lyrics_by_position(lines: DataFrame, wanted: DataFrame, by: str, line: str, share: float = 0.8) -> DataFrame:
    """(by, pos, syllable): syllables of lines (by, line, svaras, sahitya: arrays, sahitya may be null) at the places that they lie on, where at least ``share`` of the
    line's svaras agree with those wanted (by, letters). A line that doesn't agree still takes its room; from a line that goes past the end on nothing counts."""
    n = F.when(F.size("sahitya") > 0, F.size("sahitya")).otherwise(F.size("svaras"))
    w = Window.partitionBy(by).orderBy(line)
    d = lines.withColumn("n", n).withColumn("at", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(wanted, by)
    d = d.filter(F.col("at") + F.col("n") <= F.size("letters"))
    own = F.filter(F.slice("letters", (F.col("at") + 1).cast("int"), F.col("n")), lambda x: x != ",")
    got = F.filter("svaras", lambda x: x != ",")
    agree = F.size(F.filter(F.arrays_zip(got.alias("g"), own.alias("o")), lambda p: p["g"].isNotNull() & p["o"].isNotNull() & F.contains(p["g"], p["o"])))
    ok = d.filter((F.size(own) > 0) & (agree >= share * F.size(own)) & (F.size("sahitya") > 0))
    return ok.select(by, "at", F.posexplode("sahitya").alias("k", "syllable")).select(by, (F.col("at") + F.col("k")).cast("int").alias("pos"), "syllable")


def owners(letters: Column) -> Column:
    """For each place the index of the svara that sounds there: "," holds the one before it."""
    return F.transform(F.sequence(F.lit(1), F.size(letters)), lambda k: F.greatest(F.lit(0), F.size(F.filter(F.slice(letters, 1, k), lambda x: x != ",")) - 1))


def affine(m: tuple[float, float, float, float, float, float], x: Column, y: Column) -> Column:
    """struct<x,y>: a point moved by a matrix of six numbers."""
    a, b, c, d, e, f = m
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def product(m: tuple[float, ...], n: tuple[float, ...]) -> tuple[float, ...]:
    """The matrix that moves as m and then n do."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)
