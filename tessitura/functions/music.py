"""Scalar expressions of pitch, and the fixed tables of the twelve places of an octave."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cents of the twelve places in equal temperament and in just intonation.
EQUAL = [0, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1100]
JUST = [0, 90, 204, 294, 386, 498, 590, 702, 792, 906, 996, 1088]
# Analysis defaults.
SAMPLE_RATE, WINDOW, HOP, FMIN, FMAX = 16000, 800, 256, 70, 900
HOP_S = HOP / SAMPLE_RATE
# Angas of the seven talas and beats of the five jathis.
TALAS = {"Dhruva": "LDLL", "Matya": "LDL", "Rupaka": "DL", "Jhampa": "LAD", "Triputa": "LDD", "Ata": "LLDD", "Eka": "L"}
JATHIS = {"Tisra": 3, "Chaturasra": 4, "Khanda": 5, "Misra": 7, "Sankeerna": 9}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once. Written out, an expression would be worked out at each place where it stands, in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cents(hz: Column, tonic: Column | float) -> Column:
    """1200 * log2(hz / tonic); null where hz isn't positive."""
    return F.when(hz > 0, 1200 * F.log2(hz / tonic))


def half_up(x: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(x + 0.5)


def pitch_class(c: Column) -> Column:
    return F.pmod(c, F.lit(1200.0))


def fold_octave(c: Column) -> Column:
    """Into (-600, 600]."""
    m = F.pmod(c, F.lit(1200.0))
    return F.when(m > 600, m - 1200).otherwise(m)


def frame_time(i: Column, hop: int = HOP, rate: int = SAMPLE_RATE, window: int = WINDOW) -> Column:
    """Centre of frame i in seconds (a frame starts at i * hop / rate)."""
    return (i * hop + window / 2) / rate


def frame_count(length: Column, hop: int = HOP, rate: int = SAMPLE_RATE, window: int = WINDOW, fmin: int = FMIN) -> Column:
    lag = min(rate // fmin, window - 1)
    return F.greatest(F.lit(0), F.floor((length - window - lag) / hop)).cast("long")


def position_cents(pos: Column, temperament: str = "et") -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in (JUST if temperament == "ji" else EQUAL)]), pos.cast("int"))


def melakarta_rows() -> list[tuple[int, list[int], list[str]]]:
    """(number, places, labels) of the 72 parent scales, from the rule: two fourths, six pairs below and six above."""
    low = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    names = [("R1", "G1"), ("R1", "G2"), ("R1", "G3"), ("R2", "G2"), ("R2", "G3"), ("R3", "G3")]
    high = [("D1", "N1"), ("D1", "N2"), ("D1", "N3"), ("D2", "N2"), ("D2", "N3"), ("D3", "N3")]
    out = []
    for m, a, b in product((0, 1), range(6), range(6)):
        (r, g), (d, n) = low[a], low[b]
        out.append((m * 36 + a * 6 + b + 1, [0, r, g, 5 + m, 7, d + 7, n + 7], ["S", *names[a], f"M{m + 1}", "P", *high[b]]))
    return out


def melakartas(spark: SparkSession) -> DataFrame:
    """(mela, name, positions, labels): a table of 72 rows."""
    return spark.createDataFrame([(m, f"mela {m:02d}", p, names) for m, p, names in melakarta_rows()], "mela int, name string, positions array<int>, labels array<string>")


def kernel(sigma: float, radius: int) -> list[tuple[int, float]]:
    return [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]


def nearest_position(c: Column, positions: list[int], labels: list[str], octaves: int = 3) -> Column:
    """struct<cents,pos,label,oct> of the nearest place of a scale within ``octaves`` octaves of the tonic; first in table order on ties."""
    states = [(o, k) for o in range(-octaves, octaves + 1) for k in range(len(positions))]
    best = F.array_min(F.array(*[F.struct(F.abs(c - (o * 1200 + EQUAL[positions[k]])).alias("d"), F.lit(n).alias("n")) for n, (o, k) in enumerate(states)]))["n"]
    table = F.array(*[F.struct(F.lit(float(o * 1200 + EQUAL[positions[k]])).alias("cents"), F.lit(positions[k]).alias("pos"), F.lit(labels[k]).alias("label"), F.lit(o).alias("oct")) for o, k in states])
    return F.when(c.isNotNull(), F.get(table, best))


def avartana_beats(angas: Column, beats: Column) -> Column:
    """Beats of a cycle: L is the jathi, D two, anything else one."""
    return F.aggregate(F.split(angas, ""), F.lit(0), lambda t, a: t + F.when(a == "L", beats).when(a == "D", 2).otherwise(1))


def talas(spark: SparkSession) -> DataFrame:
    """The 35 rows of tala and jathi."""
    t = spark.createDataFrame(list(TALAS.items()), "tala string, angas string")
    j = spark.createDataFrame(list(JATHIS.items()), "jathi string, beats int")
    return t.crossJoin(j).withColumn("cycle", avartana_beats(F.col("angas"), F.col("beats")))
