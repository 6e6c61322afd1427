"""Notation as documents and as rows: tokens, sections, units, corrections, and what is loaded where."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares and widths that decide what is fast: ours, as nothing else says.
FAST, AROUND = 0.7, 4
DOCUMENT = "struct<tala:string,gridFactor:int,sections:array<struct<name:string,aksharas:double,svaras:array<struct<s:string,o:int,d:double,syl:string,sectionStart:string>>>>>"


def flat_tokens(cycles: Column) -> Column:
    """array<struct<letter,octave>> of cycles of divisions of tokens, in order: "^" counts an octave up, "_" down, without marks null; "," holds. What is no
    token raises an error."""
    def parsed(t: Column) -> Column:
        letter, marks = F.regexp_extract(t, r"^([SRGMPDN])([\^_]*)$", 1), F.regexp_extract(t, r"^([SRGMPDN])([\^_]*)$", 2)
        down = F.length(F.replace(marks, F.lit("^"), F.lit("")))
        octave = F.when(marks != "", F.length(F.replace(marks, F.lit("_"), F.lit(""))) - down).cast("int")
        wrong = F.raise_error(F.concat(F.lit("not a token: "), t)).cast("string")
        return F.struct(F.when(t == ",", F.lit(",")).when(letter != "", letter).otherwise(wrong).alias("letter"), octave.alias("octave"))

    return F.transform(F.flatten(F.flatten(cycles)), lambda t: parsed(F.trim(t)))


def written(label: Column, octave: Column) -> Column:
    """A token: "'" for each octave up, "." for each down."""
    return F.concat(label, F.when(octave > 0, F.repeat(F.lit("'"), octave)).when(octave < 0, F.repeat(F.lit("."), -octave)).otherwise(""))


def cut(column: str, starts: Callable[[Column, Column], Column]) -> Column:
    """An array's parts: each begins where ``starts`` (of an element and its place) is true. The first element must start one."""
    at = F.filter(F.transform(column, lambda x, k: F.when(starts(x, k), k)), lambda k: k.isNotNull())
    ends = F.array_append(F.slice(at, 2, F.size(at)), F.size(column))
    return F.zip_with(at, ends, lambda a, b: F.slice(column, a + 1, b - a))


def documents(rows: DataFrame, by: str, tala: Column, grid: Column) -> DataFrame:
    """(by, document): one JSON document for each piece of rows (by, section, name, pos, s, o, d, syl). Null syllables are left out."""
    svara = F.struct("s", F.col("o").cast("int").alias("o"), F.col("d").cast("double").alias("d"), "syl")
    one = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("section", "pos", "name", svara.alias("v")))).alias("p"), F.first(tala).alias("tala"), F.first(grid).cast("int").alias("gridFactor"))
    new = cut("p", lambda x, k: (k == 0) | ~x["section"].eqNullSafe(F.get("p", k - 1)["section"]))
    total = lambda p: F.when(F.exists(p, lambda x: x["v"]["d"].isNotNull()), F.aggregate(p, F.lit(0.0), lambda t, x: t + F.coalesce(x["v"]["d"], F.lit(0.0))))
    section = lambda p: F.struct(F.array_min(F.transform(p, lambda x: x["name"])).alias("name"), total(p).alias("aksharas"), F.transform(p, lambda x: x["v"]).alias("svaras"))
    return one.select(by, F.to_json(F.struct("tala", "gridFactor", F.transform(new, section).alias("sections"))).alias("document"))


def document_rows(docs: DataFrame, by: str, document: str = "document") -> DataFrame:
    """Rows (by, section, name, pos, s, o, d, syl) of documents, either with a section in each entry or with all svaras in the first and marks where one starts."""
    def entry(e: Column) -> Column:
        return F.transform(e["svaras"], lambda v, k: F.struct(((k == 0) | v["sectionStart"].isNotNull()).alias("starts"), F.coalesce(v["sectionStart"], e["name"]).alias("name"), v.alias("v")))

    whole = F.flatten(F.filter(F.transform("d.sections", entry), lambda e: e.isNotNull()))
    d = docs.select(by, F.from_json(document, DOCUMENT).alias("d")).select(by, whole.alias("all"))
    section = F.posexplode(cut("all", lambda x, k: x["starts"])).alias("section", "part")
    v = d.select(by, section).select(by, "section", F.get("part", F.lit(0))["name"].alias("name"), F.posexplode("part").alias("pos", "x"))
    return v.select(by, "section", "name", "pos", "x.v.s", "x.v.o", "x.v.d", "x.v.syl")


def with_structure(docs: DataFrame, structure: Column, document: str = "document") -> DataFrame:
    """Documents with a new field ``structure``; the rest of them stays."""
    # Read in a step of its own: fields taken from from_json in one expression would each read the text anew.
    d = docs.withColumn("__d", F.from_json(document, DOCUMENT))
    new = F.struct(*[F.col(f"__d.{c}").alias(c) for c in ("tala", "gridFactor", "sections")], structure.alias("structure"))
    return d.withColumn(document, F.to_json(F.when(F.col("__d").isNotNull(), new))).drop("__d")


def first_value(value: Column) -> Column:
    """The text of a JSON value that may be a text, a list (its first) or an object (its name, else title)."""
    v = F.try_parse_json(value)
    inner = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    return F.coalesce(F.try_variant_get(inner, "$.name", "string"), F.try_variant_get(inner, "$.title", "string"), F.when(~F.schema_of_variant(inner).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(inner, "$", "string")))


def contributed(rows: DataFrame, by: str) -> DataFrame:
    """(by, flat, document) of rows (by, section, name, pos, s, o, d, syl): all sections in a row, syllables left out of ``flat``; in the document the first
    svara of a section says which starts."""
    token = written(F.col("s"), F.col("o"))
    svara = F.struct("s", F.col("o").cast("int").alias("o"), F.col("d").cast("double").alias("d"), "syl")
    one = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("section", "pos", token.alias("t"), svara.alias("v"), "name"))).alias("p"))
    first = lambda x, k: (k == 0) | ~x["section"].eqNullSafe(F.get("p", k - 1)["section"])
    svaras = F.transform("p", lambda x, k: F.struct(*[x["v"][c].alias(c) for c in ("s", "o", "d", "syl")], F.when(first(x, k), x["name"]).alias("sectionStart")))
    return one.select(by, F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("flat"), F.to_json(F.struct(F.array(F.struct(svaras.alias("svaras"))).alias("sections"))).alias("document"))


def units(notes: DataFrame, by: str, order: str, group: str, commas: str, speed: float = 1.0) -> DataFrame:
    """(by, unit, first, notes, beats): notes of one group share a unit of one beat; any other note is a unit of its beat and its commas; at ``speed`` beats
    are as much shorter."""
    d = notes.withColumn("__u", F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("n"), F.col(order).cast("string"))))
    u = d.groupBy(by, "__u").agg(F.min(order).alias("first"), F.count("*").alias("notes"), (F.when(F.first(group).isNotNull(), 1).otherwise(1 + F.first(commas)) / speed).cast("double").alias("beats"))
    return u.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("first")) - 1).alias("unit"), "first", "notes", "beats")


def group_fast(notes: DataFrame, by: str, order: str, dur: str, transit: str, ratio: float = FAST, around: int = AROUND) -> DataFrame:
    """Adds ``beat_group``: runs of two to four notes that are shorter than ``ratio`` times the median of those around them (transit ones don't count and are
    never in a group); longer runs are cut into fours, what is left alone stays alone."""
    real = notes.filter(~F.col(transit)).withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    w = Window.partitionBy(by).orderBy("__k")
    near = F.array_sort(F.concat(F.collect_list(dur).over(w.rowsBetween(-around, -1)), F.collect_list(dur).over(w.rowsBetween(1, around))))
    n = F.size("__near")
    mid = lambda k: F.get("__near", k.cast("int"))
    median = F.when(n % 2 == 1, mid((n - 1) / 2)).otherwise((mid(n / 2 - 1) + mid(n / 2)) / 2)
    d = real.withColumn("__near", near).withColumn("__fast", F.coalesce(F.col(dur) < ratio * median, F.lit(False)))
    d = d.withColumn("__run", F.sum(F.when(F.col("__fast") & F.lag("__fast", 1, False).over(w), 0).otherwise(1)).over(w)).filter("__fast")
    inner = F.row_number().over(Window.partitionBy(by, "__run").orderBy("__k")) - 1
    d = d.withColumn("__cut", F.floor(inner / 4)).withColumn("__size", F.count("*").over(Window.partitionBy(by, "__run", "__cut")))
    grouped = d.filter("__size >= 2").select(by, order, F.min(order).over(Window.partitionBy(by, "__run", "__cut")).alias("beat_group"))
    return notes.join(grouped, [by, order], "left")


def anchor_index(notes: DataFrame, anchors: DataFrame, by: str, order: str, transit: str) -> DataFrame:
    """(by, anchor, index): the anchor, kept as a note's id so that deleting others doesn't move it, and where it now stands; the first note that isn't in transit
    where none was set; null where the anchor itself is gone. anchors: (by, anchor)."""
    w = Window.partitionBy(by).orderBy(order)
    d = notes.withColumn("__i", (F.row_number().over(w) - 1).cast("int"))
    first = d.filter(~F.col(transit)).groupBy(by).agg(F.min(order).alias("first"))
    known = anchors.join(first, by, "left").withColumn("anchor", F.coalesce("anchor", "first")).select(by, "anchor")
    return known.join(d.select(by, F.col(order).alias("anchor"), F.col("__i").alias("index")), [by, "anchor"], "left").select(by, F.when(F.col("index").isNotNull(), F.col("anchor")).alias("anchor"), "index")


def corrected(notes: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Notes with the edits' values where those aren't null, ``edited`` where a label changed, syllables cleared where asked for, and deleted ones gone.

    edits: one row a note (keys, columns, clear_syl, deleted)."""
    new = edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.col("clear_syl").alias("__clear"), F.col("deleted").alias("__gone"))
    j = notes.join(new, keys, "left").filter(~F.coalesce("__gone", F.lit(False)))
    value = lambda c: F.when(F.coalesce("__clear", F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"__{c}", c)) if c == "syl" else F.coalesce(f"__{c}", c)
    return j.select(*keys, *[value(c).alias(c) for c in columns], F.coalesce(F.col("__label") != F.col("label"), F.lit(False)).alias("edited"))


def syllables_match(sections: DataFrame, syllables: str, svaras: str) -> DataFrame:
    """Adds ``ok``: as many syllables, between blanks, as svaras; nothing typed is no fault."""
    n = F.size(F.filter(F.split(F.coalesce(F.trim(syllables), F.lit("")), r"\s+"), lambda x: x != ""))
    return sections.withColumn("ok", (n == 0) | (n == F.col(svaras)))


def completeness(sections: Column, has_sahitya: Column, svaras: Column) -> Column:
    """none without notation; complete with more than one section and sahitya; else partial."""
    return F.when(svaras == 0, "none").when((sections > 1) & has_sahitya, "complete").otherwise("partial")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], title: str | None = None, superseded: tuple[str, ...] = ()) -> DataFrame:
    """Old rows whose keys aren't among the new ones and whose title begins with none of the superseded ones, and all new rows."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    for prefix in superseded:
        kept = kept.filter(~F.startswith(F.coalesce(title, F.lit("")), F.lit(prefix)))
    return kept.select(old.columns).unionByName(new.select(old.columns))


def apply_suggestions(notes: DataFrame, pairs: DataFrame, allowed: DataFrame, by: str, order: str) -> DataFrame:
    """Notes with the suggested label of the alignment's pairs (by, order, suggested) where the scale has it (allowed: by, label); changed ones are ``edited``."""
    good = pairs.join(allowed.select(by, F.col("label").alias("suggested")).distinct(), [by, "suggested"], "left_semi").select(by, order, "suggested")
    j = notes.join(good, [by, order], "left")
    return j.withColumn("edited", F.coalesce(F.col("suggested") != F.col("label"), F.lit(False))).withColumn("label", F.coalesce("suggested", "label")).drop("suggested")
