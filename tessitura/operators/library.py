"""Operators over the library: cycles, notation, names, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.names import edit_budget, scale_key


def anga_boundaries(angas: Column, beats: Column) -> Column:
    """Running beats at the end of each anga."""
    size = F.transform(F.split(angas, ""), lambda a: F.when(a == "L", beats).when(a == "D", 2).otherwise(1))
    return F.transform(F.sequence(F.lit(1), F.size(size)), lambda k: F.aggregate(F.slice(size, 1, k), F.lit(0), lambda t, x: t + x))


def bar_levels(units: DataFrame, by: str, order: str, beats: str, boundaries: list[int], anchor: str) -> DataFrame:
    """level: avartana at the unit that begins at or first after a whole cycle from the anchor, anga at an inner boundary, else null.

    ``anchor``: column with the order of the unit that starts a cycle (null: no bars). Beats run both ways from it."""
    cycle = boundaries[-1]
    w = Window.partitionBy(by).orderBy(order)
    at = F.coalesce(F.sum(beats).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = units.withColumn("__at", at)
    zero = F.max(F.when(F.col(order) == F.col(anchor), F.col("__at"))).over(Window.partitionBy(by))
    d = d.withColumn("__from", F.col("__at") - zero)
    level = lambda c: F.floor(c / cycle)
    inner = lambda c: level(c) * len(boundaries) + F.size(F.filter(F.array(*[F.lit(b) for b in boundaries]), lambda b: b <= F.pmod(c, F.lit(cycle))))
    before = F.lag("__from").over(w)
    turned, moved = level(F.col("__from")) != level(before), inner(F.col("__from")) != inner(before)
    first = before.isNull()
    exact = lambda c: F.pmod(c, F.lit(cycle)) == 0
    edge = F.array_contains(F.array(*[F.lit(b) for b in boundaries[:-1]]), F.pmod(F.col("__from"), F.lit(cycle)).cast("int"))
    return d.withColumn("level", F.when(first, F.when(exact(F.col("__from")), "avartana").when(edge, "anga")).when(turned, "avartana").when(moved, "anga")).drop("__at", "__from")


def wrap_rows(cells: DataFrame, by: str, order: str, countable: str, width: int = 8) -> DataFrame:
    """row: at most ``width`` countable cells a row; others ride along with what stands before them."""
    n = F.sum(F.col(countable).cast("int")).over(Window.partitionBy(by).orderBy(order))
    return cells.withColumn("row", F.floor((F.greatest(n, F.lit(1)) - 1) / width))


def comma_count(dur: Column, unit: Column, manual: Column) -> Column:
    """Held units after the first, 0 to 7; a manual count wins, 0 included; without a unit 0."""
    return F.coalesce(manual, F.when(unit > 0, F.greatest(F.lit(0), F.least(F.lit(7), F.floor(dur / unit + 0.5) - 1))).otherwise(0)).cast("int")


def duration_ok(total: Column, first: Column, cycle: Column) -> Column:
    """Whether the beats are a whole number of cycles, one at least, at speed 1, 2 or 4, with or without a pickup before the first bar."""
    whole = lambda beats, k: (beats / (cycle * k) >= 1 - 1e-6) & (F.abs(beats / (cycle * k) - F.floor(beats / (cycle * k) + 0.5)) < 1e-6)
    return F.coalesce(total > 0, F.lit(False)) & F.exists(F.array(*[F.lit(k) for k in (1, 2, 4)]), lambda k: whole(total, k) | (first < cycle * k) & whole(total + cycle * k - first, k))


def timed_targets(rows: DataFrame, by: str, order: str, d: str, grid: int, tempo: float) -> DataFrame:
    """start_s and end_s of units laid end to end."""
    w = Window.partitionBy(by).orderBy(order)
    unit = 60.0 / tempo / grid
    return rows.withColumn("end_s", F.sum(d).over(w) * unit).withColumn("start_s", F.col("end_s") - F.col(d) * unit)


def judge(dev: Column, hit: float = 40, near: float = 75, least: int = 4) -> Column:
    """hit, near, miss or none from the median of absolute deviations; the cut between near and miss is ours (60 is near, 100 a miss), as is the least count."""
    m = F.median(F.abs(dev))
    return F.when(F.count(dev) < least, "none").when(m <= hit, "hit").when(m <= near, "near").otherwise("miss")


def dedupe_prefer(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).filter("__n = 1").drop("__n", "__key")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have the key, values of ``new`` that aren't null win."""
    fresh = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("__new"))
    joined = old.join(fresh, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key])


def carry_forward(df: DataFrame, value: Column, by: str, order: str) -> DataFrame:
    """carried: the last value that isn't null, up to and with this row."""
    return df.withColumn("carried", F.last(value, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def chain_cluster(df: DataFrame, by: str, order: list[str], value: str, gap: float) -> DataFrame:
    """cluster: neighbours in order at most ``gap`` apart chain into one."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__new", F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(1))).withColumn("cluster", F.sum("__new").over(w)).drop("__new")


def unambiguous_keys(names: DataFrame, name: str, key: Column) -> DataFrame:
    """(key, name) of keys that belong to one name only."""
    return names.select(key.alias("key"), F.col(name).alias("name")).groupBy("key").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).filter("n = 1").select("key", "name")


def fuzzy_rank(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Adds match and distance: the name with an equal key, else the nearest within the edit budget (the first on ties), else null.

    Candidates share a piece of their keys: of budget + 1 pieces of a query's key one survives any edits, shifted by the budget at most; so
    no pair of all queries with all names is built. Names without a key are never matched. queries: (q); names: (ord, name)."""
    q = queries.select("q").distinct().withColumn("key", scale_key(F.col("q"))).filter("key <> ''").withColumn("budget", edit_budget(F.col("key")))
    n = names.select("ord", "name", scale_key(F.col("name")).alias("nkey")).filter("nkey <> ''")
    exact = q.join(n, q.key == n.nkey).groupBy("q").agg(F.min(F.struct(F.lit(0).alias("d"), "ord", "name")).alias("m"))
    rest = q.join(exact, "q", "left_anti")
    size, b = F.length("key"), F.col("budget")
    pieces = F.transform(F.sequence(F.lit(0), b), lambda k: F.struct(F.floor(size * k / (b + 1)).alias("at"), F.floor(size * (k + 1) / (b + 1)).alias("to")))
    # A piece that survives stands in a name of nearly the same length at nearly the same place: both are keys of the join.
    moved = F.sequence(-b, b)
    rest = rest.withColumn("p", F.explode(pieces)).withColumn("piece", F.substr("key", (F.col("p.at") + 1).cast("int"), (F.col("p.to") - F.col("p.at")).cast("int"))).filter("piece <> ''")
    rest = rest.withColumn("longer", F.explode(moved)).withColumn("shift", F.explode(moved)).select("q", "key", "budget", "piece", (size + F.col("longer")).alias("length"), (F.col("p.at") + 1 + F.col("shift")).cast("int").alias("start"))
    own = F.length("nkey")
    parts = lambda m: F.when(m >= 8, 3).otherwise(2)
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), own - 2), own + 2), lambda m: F.array(F.floor(m / parts(m)), F.ceil(m / parts(m))))))
    grams = n.withColumn("l", F.explode(F.filter(sizes, lambda x: (x > 0) & (x <= own)))).withColumn("start", F.explode(F.sequence(F.lit(1), (own - F.col("l") + 1).cast("int"))))
    grams = grams.select("ord", "name", "nkey", F.substr("nkey", F.col("start"), F.col("l").cast("int")).alias("piece"), own.alias("length"), "start")
    near = rest.join(grams, ["piece", "length", "start"]).select("q", "key", "budget", "ord", "name", "nkey").distinct()
    near = near.withColumn("d", F.levenshtein("key", "nkey")).filter(F.col("d") <= F.col("budget")).groupBy("q").agg(F.min(F.struct("d", "ord", "name")).alias("m"))
    found = exact.unionByName(near)
    return queries.join(found, "q", "left").withColumn("match", F.col("m.name")).withColumn("distance", F.col("m.d")).drop("m")


def trigrams(c: Column) -> Column:
    return F.array_distinct(F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def token_octave(token: Column) -> Column:
    """Octave of a written token: "'" counts up, "." down."""
    marks = F.regexp_extract(token, r"(['.]*)$", 1)
    return (F.length(F.regexp_replace(marks, "[.]", "")) - F.length(F.regexp_replace(marks, "'", ""))).cast("int")


def token_line(line: Column, pattern: str, least: int = 8, share: float = 0.8) -> Column:
    """Whether a line has ``least`` tokens or more of which a share matches."""
    t = F.filter(F.split(line, " "), lambda x: x != "")
    return (F.size(t) >= least) & (F.size(F.filter(t, lambda x: x.rlike(pattern))) / F.size(t) >= share)


def gcd(a: Column, b: Column, steps: int = 16) -> Column:
    """Greatest common divisor of small numbers by Euclid's steps."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))["a"]


def lcm_of(values: Column) -> Column:
    """Least common multiple of an array of small positive numbers."""
    return F.aggregate(values, F.lit(1).cast("long"), lambda t, x: (t / gcd(t, x) * x).cast("long")).cast("int")


def staged_load(new: DataFrame, old: DataFrame, key: str, match: list[str]) -> DataFrame:
    """(key, kriti_id, inserted): new rows linked to the old row with the smallest key that agrees in ``match``; those without one are inserted once for each value of ``match``, then linked."""
    have = old.groupBy(*match).agg(F.min(key).alias("__old"))
    linked = new.select(key, *match).join(have, match, "left")
    fresh = linked.filter("__old is null").groupBy(*match).agg((F.min(key) + 1000000).alias("__new"))
    return linked.join(fresh, match, "left").select(key, F.coalesce("__old", "__new").alias("kriti_id"), F.col("__old").isNull().alias("inserted"))


def rendered(label: Column, octave: Column, artic: Column | None = None) -> Column:
    """A label with a dot below or above its letter for the octave, one more at its end for the next, and a mark for how it is sung."""
    below, above = "\u0323", "\u0307"
    dot = F.when(octave <= -1, F.lit(below)).when(octave >= 1, F.lit(above)).otherwise("")
    far = F.when(octave <= -2, F.lit(below)).when(octave >= 2, F.lit(above)).otherwise("")
    mark = F.lit("") if artic is None else F.when(artic == "kampita", "~").when(artic == "slide-up", "/").when(artic == "slide-down", "\\").otherwise("")
    return F.concat(F.substr(label, F.lit(1), F.lit(1)), dot, F.substr(label, F.lit(2)), far, mark)


def notation_text(notes: DataFrame, width: int = 8, hide_transit: bool = True, marks: bool = True, default_unit: float = 0.2) -> DataFrame:
    """(clip_id, text): notes as written lines of ``width`` cells; a comma for each unit that a note is held on. The unit is the 35th of a hundred durations in
    order, of all the clip's notes. notes: (clip_id, idx, label, oct, dur, artic, transit)."""
    unit = notes.groupBy("clip_id").agg(F.array_sort(F.collect_list("dur")).alias("d")).select("clip_id", F.coalesce(F.get("d", F.floor(F.size("d") * 0.35).cast("int")), F.lit(default_unit)).alias("unit"))
    shown = notes.filter(~F.col("transit")) if hide_transit else notes
    cell = F.concat(rendered(F.col("label"), F.col("oct"), F.col("artic") if marks else None), F.repeat(F.lit(" ,"), comma_count(F.col("dur"), F.col("unit"), F.lit(None).cast("int"))))
    rows = shown.join(unit, "clip_id").withColumn("__k", F.row_number().over(Window.partitionBy("clip_id").orderBy("idx")) - 1).withColumn("__row", F.floor(F.col("__k") / width)).withColumn("__cell", cell)
    lines = rows.groupBy("clip_id", "__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__cell"))), lambda t: t["__cell"]), "  ").alias("line"))
    return lines.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__row", "line"))), lambda t: t["line"]), "\n").alias("text"))
