"""Scales as lists of written tokens: places, kinds, sets of labels, and letters resolved against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.music import let

# Semitones of the written labels, names by the number of different notes, and labels of the twelve pitches of the tonic.
PITCH = {"S": 0, "R1": 1, "R2": 2, "R3": 3, "G1": 2, "G2": 3, "G3": 4, "M1": 5, "M2": 6, "P": 7, "D1": 8, "D2": 9, "D3": 10, "N1": 9, "N2": 10, "N3": 11}
COUNT_NAMES = {7: "sampurna", 6: "shadava", 5: "audava", 4: "svarantara", 3: "svarantara"}
KATTAI = {"C": "1", "C#": "1½", "D": "2", "D#": "2½", "E": "3", "F": "4", "F#": "4½", "G": "5", "G#": "5½", "A": "6", "A#": "6½", "B": "½"}
FAMILIES = ("R", "G", "M", "P", "D", "N")


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def bare(token: Column) -> Column:
    """A label without the marks of its octave."""
    return F.regexp_replace(token, r"[.']*$", "")


def positions(tokens: Column) -> Column:
    """Semitones above the tonic; "'" counts an octave up, "." one down; null for what is no label."""
    marks = lambda t, m: F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))
    return F.transform(tokens, lambda t: (_map(PITCH)[bare(t)] + 12 * (marks(t, "'") - marks(t, "."))).cast("int"))


def bound(tokens: Column, ascending: bool) -> Column:
    """The plain tonic that ends an ascending line or begins a descending one is the upper one."""
    n = F.size(tokens)
    if ascending:
        return F.when((n > 0) & (F.get(tokens, n - 1) == "S"), F.concat(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.array(F.lit("S'")))).otherwise(tokens)
    return F.when((n > 0) & (F.get(tokens, F.lit(0)) == "S"), F.concat(F.array(F.lit("S'")), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))))).otherwise(tokens)


def _turns(p: Column, up: bool) -> Column:
    pairs = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.coalesce(y < x if up else y > x, F.lit(False)))
    return F.exists(pairs, lambda t: t)


def classify(ascent: Column, descent: Column) -> Column:
    """struct<up,down,kind,vakra,varja>: numbers of different labels, the name of the kind, whether a line turns, and the families that are left out."""
    a, d = F.array_distinct(F.transform(ascent, bare)), F.array_distinct(F.transform(descent, bare))
    name = lambda n: F.coalesce(_map(COUNT_NAMES)[n], n.cast("string"))
    vakra = _turns(positions(bound(ascent, True)), True) | _turns(positions(bound(descent, False)), False)
    kind = F.when(F.size(a) == F.size(d), name(F.size(a))).otherwise(F.concat_ws("-", name(F.size(a)), name(F.size(d))))
    present = F.transform(F.array_union(a, d), lambda t: F.substr(t, F.lit(1), F.lit(1)))
    varja = F.array_except(F.array(*[F.lit(f) for f in FAMILIES]), present)
    return F.struct(F.size(a).alias("up"), F.size(d).alias("down"), F.concat(kind, F.when(vakra, " vakra").otherwise("")).alias("kind"), vakra.alias("vakra"), varja.alias("varja"))


def scale_places(ascent: Column, descent: Column) -> Column:
    """array<struct<pos,label>>: the first label of each semitone of both lines, lowest first."""
    labels = F.transform(F.concat(ascent, descent), bare)
    placed = F.filter(F.transform(labels, lambda t, k: F.struct(_map(PITCH)[t].alias("pos"), k.alias("k"), t.alias("label"))), lambda s: s["pos"].isNotNull())
    first = let(F.array_sort(placed), lambda o: F.filter(o, lambda s, i: (i == 0) | (F.get(o, i - 1)["pos"] != s["pos"])))
    return F.transform(first, lambda s: F.struct(s["pos"].alias("pos"), s["label"].alias("label")))


def is_subset(wanted: Column, printed: Column) -> Column:
    return F.size(F.array_except(wanted, printed)) == 0


def resolve_letter(token: Column, labels: Column) -> Column:
    """Semitones of a written token: a spelt label stands for itself, a bare letter for the one label of the scale that begins so; null where there is
    none or more than one, and for what is no label."""
    own = F.filter(labels, lambda x: F.substr(x, F.lit(1), F.lit(1)) == token)
    letter = F.when((F.length(token) == 1) & (F.size(own) == 1), _map(PITCH)[F.get(own, F.lit(0))])
    return F.coalesce(_map(PITCH)[token], letter)


def kattai_table(spark: SparkSession) -> DataFrame:
    """(pitch, semitone, label): the twelve pitches that the tonic may have. A fixed table."""
    return spark.createDataFrame([(p, n, f"{p} · {k} kattai") for n, (p, k) in enumerate(KATTAI.items())], "pitch string, semitone int, label string")


def derived_scales(scales: DataFrame) -> DataFrame:
    """Scales (name, parent, ascent, descent arrays) with kind, places and those of the parent scale of that name (null where there is none)."""
    d = scales.withColumn("c", classify(F.col("ascent"), F.col("descent"))).withColumn("places", scale_places(F.col("ascent"), F.col("descent")))
    parents = d.select(F.col("name").alias("parent"), F.col("places").alias("parent_places")).groupBy("parent").agg(F.min("parent_places").alias("parent_places"))
    return d.join(parents, "parent", "left").select("name", "parent", "c.*", "places", "parent_places")
