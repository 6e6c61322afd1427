"""Records of a corpus: what a folder has, which are worth taking, their sections, excerpts and wiki cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.names import fold, phonetic_key

# Labels of sections by folded spelling: of the composition, and of what a concert puts around it.
COMPOSITION = {
    "pallavi": "Pallavi", "anupallavi": "Anupallavi", "caranam": "Charanam", "charanam": "Charanam", "samashticaranam": "Samashti Charanam", "cittasvara": "Chittasvaram", "chittasvara": "Chittasvaram",
    "muktayisvara": "Muktayisvaram", "madhyamakala": "Madhyamakala", "melkalam": "Madhyamakala", "jatisvara": "Jatisvaram",
}
PERFORMANCE = {
    "vocalalap": "Vocal alapana", "violinalap": "Violin alapana", "alap": "Alapana", "kalpanasvara": "Kalpana svara", "nereval": "Neraval", "neraval": "Neraval", "taniavartana": "Tani avartana",
    "sloka": "Shloka", "viruttam": "Viruttam", "mangalam": "Mangalam", "ragamalikasvara": "Ragamalika svara", "tisram": "Tisra gati", "svarakalpana": "Kalpana svara",
}
# What a file's name shows of a record, and how much that counts.
EVIDENCE = {".multitrack-vocal.mp3": 4, ".pitch-vocal.txt": 3, ".mphrases-manual.txt": 3, ".ctonic.txt": 2, ".pitch.txt": 2, ".sections-manual": 1}
# Headings of columns in lists, by field.
HEADERS = {
    "composition": "title", "kriti": "title", "krithi": "title", "kruti": "title", "song": "title", "name": "title", "compositions": "title", "krithis": "title", "raga": "ragam", "ragam": "ragam",
    "raagam": "ragam", "raaga": "ragam", "rāga": "ragam", "ragas": "ragam", "tala": "tala", "talam": "tala", "taala": "tala", "taalam": "tala", "tāḷa": "tala", "thala": "tala", "thalam": "tala",
    "language": "language", "deity": "deity", "god": "deity", "kshetra": "place", "kshetram": "place", "temple": "place", "place": "place", "sthala": "place",
}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def classify_section(label: Column) -> Column:
    """struct<name,kind,scale>: by the whole label, else by its first word, with the rest as the scale's name; what is unknown keeps its label as "other"."""
    words = F.filter(F.split(F.trim(label), r"\s+"), lambda w: w != "")
    head, rest = fold(F.get(words, F.lit(0))), F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " "))
    named = lambda key, scale: F.coalesce(*[F.when(_map(t)[key].isNotNull(), F.struct(_map(t)[key].alias("name"), F.lit(k).alias("kind"), scale.alias("scale"))) for t, k in ((COMPOSITION, "composition"), (PERFORMANCE, "performance"))])
    none = F.lit(None).cast("string")
    return F.coalesce(named(fold(label), none), F.when(rest.isNotNull(), named(head, rest)), F.struct(F.trim(label).alias("name"), F.lit("other").alias("kind"), none.alias("scale")))


def track_evidence(files: DataFrame, by: str, path: str) -> DataFrame:
    """(by, score, usable, annotated) of the files of each folder: each kind of evidence counts once."""
    has = {k: F.max(F.contains(path, F.lit(k)).cast("int")) for k in (*EVIDENCE, ".json")}
    d = files.groupBy(by).agg(*[c.alias(f"h{n}") for n, c in enumerate(has.values())])
    on = {k: F.col(f"h{n}") for n, k in enumerate(has)}
    score = sum((on[k] * w for k, w in EVIDENCE.items()), F.lit(0))
    yes = {k: c == 1 for k, c in on.items()}
    return d.select(by, score.alias("score"), (yes[".ctonic.txt"] & (yes[".pitch.txt"] | yes[".pitch-vocal.txt"])).alias("usable"), (yes[".json"] & (yes[".sections-manual"] | yes[".mphrases-manual.txt"])).alias("annotated"))


def select_tracks(evidence: DataFrame, by: str, most: int = 0, annotations_only: bool = False) -> DataFrame:
    """The usable (or annotated) records with most evidence, by name on ties; ``most`` of them, all if 0."""
    ranked = evidence.filter("annotated" if annotations_only else "usable").orderBy(F.desc("score"), by)
    return ranked.limit(most) if most else ranked


def limit_records(records: DataFrame, key: str, most: int = 0, only: Column | None = None) -> DataFrame:
    """The first ``most`` records in order of ``key`` that fulfil ``only``; all if 0."""
    d = records if only is None else records.filter(only)
    return d.orderBy(key).limit(most) if most else d.orderBy(key)


def trim_contour(contour: DataFrame, seconds: float) -> DataFrame:
    return contour.filter(F.col("t_s") <= seconds)


def scan_all(*corpora: DataFrame) -> DataFrame:
    """The records of all corpora under one another, columns that one lacks null."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def nearest_above(files: DataFrame, anchors: DataFrame, most: int = 5) -> DataFrame:
    """(path, found): for each anchor file the one of ``files`` (path) in its folder or at most ``most`` folders up, the nearest; null without one.

    Anchors are exploded to their folders, so the join is on equality."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    up = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split(folder(F.col("path")), "/"), 1, F.greatest(F.size(F.split(folder(F.col("path")), "/")) - k, F.lit(0))), "/").alias("at")))
    own = anchors.select("path", F.explode(up).alias("u")).select("path", "u.depth", "u.at").filter("at <> ''")
    there = files.groupBy(folder(F.col("path")).alias("at")).agg(F.min("path").alias("found"))
    best = own.join(there, "at").groupBy("path").agg(F.min_by("found", "depth").alias("found"))
    return anchors.select("path").join(best, "path", "left")


def excerpt_candidates(sections: DataFrame, by: str, length: float, pad: float = 6.0, most: int = 4) -> DataFrame:
    """(by, k, start_s): places for an excerpt inside the sections (start_s, end_s), the longest first, three in each, none near one before it."""
    room = F.col("end_s") - F.col("start_s") - length
    fits = sections.filter(F.col("end_s") - F.col("start_s") >= length + pad)
    spans = fits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-(F.col("end_s") - F.col("start_s"))).alias("d"), F.col("start_s").alias("a"), F.col("end_s").alias("b"), room.alias("room")))).alias("s"))
    starts = F.flatten(F.transform("s", lambda s: F.filter(F.transform(F.array(F.lit(0.15), F.lit(0.45), F.lit(0.7)), lambda f: s["a"] + pad + s["room"] * f), lambda t: t + length <= s["b"])))
    apart = F.aggregate(starts, F.array().cast("array<double>"), lambda kept, t: F.when(F.forall(kept, lambda u: F.abs(t - u) > length / 2), F.array_append(kept, t)).otherwise(kept))
    return spans.select(by, F.posexplode(F.slice(apart, 1, most)).alias("k", "start_s"))


def first_audible(candidates: DataFrame, by: str, silent: float = -50.0) -> DataFrame:
    """(by, start_s, level): the first candidate (k, start_s, level) that isn't silent, the last if all are."""
    loud = F.col("level") > silent
    return candidates.groupBy(by).agg(F.coalesce(F.min_by(F.when(loud, F.struct("start_s", "level")), F.when(loud, F.col("k"))), F.max_by(F.struct("start_s", "level"), "k")).alias("c")).select(by, "c.*")


def _word_is_indic(w: Column) -> Column:
    letters = F.length(F.regexp_replace(w, r"\P{L}", ""))
    indic = F.length(F.regexp_replace(w, r"[^\x{0900}-\x{0DFF}\x{0E00}-\x{0FFF}\x{11300}-\x{1137F}]|\P{L}", ""))
    return (letters > 0) & (indic >= 0.6 * letters)


def plain_cell(cell: Column) -> Column:
    """Readable text of a wiki cell: links as they are shown, no references, templates, tags or quotes, no words in Indic script."""
    c = cell
    for pattern, by in ((r"(?is)<ref[^>]*>.*?</ref>", ""), (r"(?i)<ref[^>]*/>", ""), (r"(?is)<br\s*/?>.*$", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"<[^>]+>", ""), ("'''", ""), ("''", "")):
        c = F.regexp_replace(c, pattern, by)
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: (w != "") & ~_word_is_indic(w))
    return F.regexp_replace(F.array_join(words, " "), r"^[ \t|]+|[ \t|]+$", "")


def template_tokens(cell: Column) -> Column:
    """Tokens of a scale template in a wiki cell, parameters left out; null without one or if a token is no label."""
    from tessitura.operators.scales import PITCH, bare

    inside = F.regexp_extract(cell, r"(?s)\{\{\s*svaraC\s*\|(.*?)\}\}", 1)
    tokens = F.filter(F.transform(F.split(inside, r"\|"), lambda t: F.replace(F.trim(t), F.lit("’"), F.lit("'"))), lambda t: (t != "") & ~F.contains(t, F.lit("=")))
    return F.when((F.size(tokens) > 0) & F.forall(tokens, lambda t: bare(t).isin(*PITCH)), tokens)


def columns_by_header(header: Column, cells: Column) -> Column:
    """map<field,cell>: cells by what their heading means; unknown headings and missing cells are left out, of two columns of one field the first counts."""
    key = lambda h: F.lower(F.trim(F.regexp_replace(h, r"[^\p{L} ]", "")))
    pairs = F.filter(F.zip_with(header, cells, lambda h, c: F.struct(_map(HEADERS)[key(h)].alias("k"), c.alias("v"))), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def name_candidates(raw: Column) -> Column:
    """What a written name may stand for, in order: without brackets, what stands in them, parts at "/", and each with or without a final m."""
    outer = F.regexp_replace(raw, r"\([^)]*\)", "")
    inner = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: F.split(x, "/")))
    every = F.filter(F.transform(F.concat(F.array(outer), inner, F.split(outer, "/")), lambda c: F.trim(c)), lambda c: c != "")
    more = F.flatten(F.transform(every, lambda c: F.when(F.endswith(c, F.lit("m")), F.array(F.concat(c, F.lit("m")), F.substr(c, F.lit(1), F.length(c) - 1))).otherwise(F.array(F.concat(c, F.lit("m"))))))
    return F.concat(every, more)


def match_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Adds match and tier to queries (raw): the name that a candidate has by letters (tier 1, the first in table order), else by sound (tier 2; keys of
    several names don't count). names: (ord, name). Earlier candidates win within a tier; null without a match."""
    exact = names.groupBy(fold(F.col("name")).alias("key")).agg(F.min_by("name", "ord").alias("name")).select(F.lit(1).alias("tier"), "key", "name")
    sound = names.groupBy(phonetic_key(F.col("name")).alias("key")).agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).filter("n = 1").select(F.lit(2).alias("tier"), "key", "name")
    tried = queries.select("raw").distinct().select("raw", F.posexplode(name_candidates(F.col("raw"))).alias("k", "c"))
    tried = tried.select("raw", "k", F.explode(F.array(F.struct(F.lit(1).alias("tier"), fold(F.col("c")).alias("key")), F.struct(F.lit(2).alias("tier"), phonetic_key(F.col("c")).alias("key")))).alias("t")).select("raw", "k", "t.*")
    best = tried.join(exact.unionByName(sound), ["tier", "key"]).groupBy("raw").agg(F.min(F.struct("tier", "k", "name")).alias("m"))
    return queries.join(best, "raw", "left").withColumn("match", F.col("m.name")).withColumn("tier", F.col("m.tier")).drop("m")


def crosscheck(ours: DataFrame, theirs: DataFrame, key: str, aliases: Column | None = None) -> DataFrame:
    """Our rows (key, places) against theirs of that key, else of its alias: agree, conflict or unmatched, and how the sets differ."""
    other = theirs.groupBy(F.col(key).alias("__k")).agg(F.min("places").alias("__p"))
    own = ours.withColumn("__a", aliases if aliases is not None else F.lit(None).cast("string"))
    direct = own.join(other, F.col(key) == F.col("__k"), "left").drop("__k").withColumnRenamed("__p", "__d")
    both = direct.join(other, F.col("__a") == F.col("__k"), "left").drop("__k")
    b = F.coalesce("__d", "__p")
    have = F.coalesce(b, F.array().cast(theirs.schema["places"].dataType))
    return both.select(*[F.col(c) for c in ours.columns if c != "places"], F.when(b.isNull(), "unmatched").when(F.array_sort("places") == F.array_sort(b), "agree").otherwise("conflict").alias("verdict"), F.size(F.array_except("places", have)).alias("only_a"), F.size(F.array_except(have, "places")).alias("only_b"), F.size(F.array_union("places", have)).alias("united"))


def library_order(pieces: DataFrame, most: int = 0) -> DataFrame:
    """Pieces with their notation first: by rank of the notation, then title."""
    d = pieces.orderBy(F.col("notation_rank").asc_nulls_last(), "title", "id")
    return d.limit(most) if most else d


def size_totals(files: DataFrame, kind: Column, size: str = "bytes") -> DataFrame:
    """(kind, files, bytes, shown): totals by kind of file."""
    d = files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))
    shown = F.when(F.col("bytes") >= 1e9, F.concat(F.format_string("%.2f", F.col("bytes") / 1e9), F.lit(" GB"))).otherwise(F.concat(F.format_string("%.1f", F.col("bytes") / 1e6), F.lit(" MB")))
    return d.withColumn("shown", shown)


def running_header(lines: DataFrame, by: str, order: str, pattern: str, value: str = "value") -> DataFrame:
    """Adds ``header``: what the last line that has the pattern says, up to and with this one."""
    found = F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))
    return lines.withColumn("header", F.last(found, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def header_field(text: Column, label: str) -> Column:
    """What stands behind the first line's label, blanks squeezed; null without one."""
    found = F.regexp_extract(text, rf"(?im)^\s*{label}\s*:?\s*(.+)$", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def title_of(text: Column, other: Column) -> Column:
    """The first line that isn't blank, else ``other``; in words if it is shouted."""
    first = F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*(\S.*)$", 1)), F.lit("")), other, F.lit(""))
    return F.trim(F.when((F.upper(first) == first) & (F.lower(first) != first), F.initcap(first)).otherwise(first))


def header_kind(raw: Column, kinds: list[str]) -> Column:
    """struct<kind,tala> of "head — tala ...": the first kind that the head contains, or "other" where a tala is named; null for what is no header."""
    parts = F.split(raw, "—")
    head, tala = fold(F.replace(F.replace(F.get(parts, F.lit(0)), F.lit("ı"), F.lit("i")), F.lit("ȷ"), F.lit("j"))), fold(F.replace(F.get(parts, F.lit(1)), F.lit("ı"), F.lit("i")))
    is_tala = F.contains(tala, F.lit("tala"))
    kind = F.coalesce(*[F.when(F.contains(head, F.lit(k)), F.lit(k)) for k in kinds])
    return F.when(F.size(parts) >= 2, F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(is_tala, tala).otherwise("").alias("tala"))).when(is_tala & (head != ""), F.struct(F.lit("other").alias("kind"), tala.alias("tala"))))
