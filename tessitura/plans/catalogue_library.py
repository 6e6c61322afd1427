"""Scales, talas, names and records bound to the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import music, names, talas
from tessitura.operators import records, scales
from tessitura.operators.staging import dealt
from tessitura.plans.catalogue import _FOLD, _rewritten, _squeezed, query, table
from tessitura.plans.catalogue_notation import _NUMBERED, numbered

_Q = "'"


def _list(values) -> str:
    return "[" + ", ".join(_Q + str(v).replace(_Q, _Q * 2) + _Q for v in values) + "]"


def _map(d: dict) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else _Q + v.replace(_Q, _Q * 2) + _Q
    return "map {" + ", ".join(f"{cell(k)}: {cell(v)}" for k, v in d.items()) + "}"


def _phon(x: str) -> str:
    return _squeezed("replace(" + _rewritten(_FOLD.format(x), names.PHONETIC) + ", 'm', 'n')")


TOKENS = list(scales.PITCH)
_BARE = "regexp_replace({}, '[.'']*$', '')"
_LINES = f"""{_NUMBERED}, t as (select l_orderkey, n, l_extendedprice as x, {_list(TOKENS)}[(l_quantity::int % 16) + 1] || case l_partkey % 9 when 0 then '''' when 1 then '.' else '' end as tok from u),
  s as (select l_orderkey, list_concat(['S'], list(tok order by n), ['S']) as a, list_concat(['S'], list(tok order by x desc, n), ['S']) as d from t group by 1)"""


def _pos(tokens: str) -> str:
    quote = "length(x) - length(replace(x, chr(39), ''))"
    return f"list_transform({tokens}, lambda x: {_map(scales.PITCH)}[{_BARE.format('x')}] + 12 * (({quote}) - (length(x) - length(replace(x, '.', '')))))"


def _count(n: str) -> str:
    return f"coalesce({_map(scales.COUNT_NAMES)}[{n}], {n}::varchar)"


def scale_lines(spark, sf_dir):
    """(l_orderkey, ascent, descent): an order's lines as written tokens, by number and by falling price, between two tonics."""
    mark = F.when(F.col("l_partkey") % 9 == 0, "'").when(F.col("l_partkey") % 9 == 1, ".").otherwise("")
    tok = F.concat(F.get(F.array(*[F.lit(t) for t in TOKENS]), (F.col("l_quantity") % 16).cast("int")), mark)
    d = numbered(spark, sf_dir).withColumn("tok", tok).groupBy("l_orderkey").agg(F.collect_list(F.struct("n", "tok")).alias("a"), F.collect_list(F.struct((-F.col("l_extendedprice")).alias("x"), "n", "tok")).alias("d"))
    line = lambda c: F.concat(F.array(F.lit("S")), F.transform(F.array_sort(c), lambda s: s["tok"]), F.array(F.lit("S")))
    return d.select("l_orderkey", line("a").alias("ascent"), line("d").alias("descent"))


@query(f"""with {_LINES}, b as (select *, case when a[-1] = 'S' then list_concat(a[:-2], ['S''']) else a end as ba, case when d[1] = 'S' then list_concat(['S'''], d[2:]) else d end as bd from s)
  select l_orderkey, array_to_string({_pos('ba')}, ' ') as up, array_to_string({_pos('bd')}, ' ') as down from b""")
def scale_positions(spark, sf_dir):
    """Places of bounded lines."""
    show = lambda c: F.array_join(c.cast("array<string>"), " ")
    d = scale_lines(spark, sf_dir)
    return d.select("l_orderkey", show(scales.positions(scales.bound(F.col("ascent"), True))).alias("up"), show(scales.positions(scales.bound(F.col("descent"), False))).alias("down"))


@query(f"""with {_LINES}, b as (select l_orderkey, {_pos("case when a[-1] = 'S' then list_concat(a[:-2], ['S''']) else a end")} as pa, {_pos("case when d[1] = 'S' then list_concat(['S'''], d[2:]) else d end")} as pd,
    list_distinct(list_transform(a, lambda x: {_BARE.format('x')})) as la, list_distinct(list_transform(d, lambda x: {_BARE.format('x')})) as ld from s),
  v as (select *, len(list_filter(range(2, len(pa) + 1), lambda i: pa[i] < pa[i - 1])) > 0 or len(list_filter(range(2, len(pd) + 1), lambda i: pd[i] > pd[i - 1])) > 0 as vakra, len(la)::int as up, len(ld)::int as down from b)
  select l_orderkey, up, down, case when up = down then {_count('up')} else {_count('up')} || '-' || {_count('down')} end || case when vakra then ' vakra' else '' end as kind, vakra,
    array_to_string(list_filter(['R', 'G', 'M', 'P', 'D', 'N'], lambda f: not list_contains(list_transform(list_concat(la, ld), lambda x: x[1]), f)), '') as varja from v""")
def scale_kinds(spark, sf_dir):
    """Kind of scale of every order's lines."""
    c = scales.classify(F.col("ascent"), F.col("descent"))
    return scale_lines(spark, sf_dir).select("l_orderkey", c.alias("c")).select("l_orderkey", "c.up", "c.down", "c.kind", "c.vakra", F.array_join("c.varja", "").alias("varja"))


@query(f"""with {_LINES}, e as (select l_orderkey, unnest(range(len(a) + len(d))) as k, list_concat(a, d) as l from s), p as (select l_orderkey, k, {_BARE.format('l[k + 1]')} as label from e), q as (select *, {_map(scales.PITCH)}[label] as pos from p),
  f as (select l_orderkey, pos, arg_min(label, k) as label from q group by all) select l_orderkey, string_agg(pos || ':' || label, ' ' order by pos) as places from f group by 1""")
def scale_places(spark, sf_dir):
    p = scales.scale_places(F.col("ascent"), F.col("descent"))
    return scale_lines(spark, sf_dir).select("l_orderkey", F.array_join(F.transform(p, lambda s: F.concat_ws(":", s["pos"].cast("string"), s["label"])), " ").alias("places"))


_LETTERS = ["S", "P", "G", "R", "R2", "zz", ",", "M", "N3", "D"]
_MELA = ", ".join(f"({m}, {_list(ls)})" for m, _, ls in music.melakarta_rows())


@query(f"""with m(mela, labels) as (values {_MELA}), t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_list(_LETTERS)}[(l_partkey % {len(_LETTERS)}) + 1] as token, l_orderkey % 72 + 1 as mela from lineitem),
  o as (select t.*, list_filter(labels, lambda x: x[1] = token) as own from t join m using (mela))
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, token, coalesce({_map(scales.PITCH)}[token], case when length(token) = 1 and len(own) = 1 then {_map(scales.PITCH)}[own[1]] end)::int as pos from o""")
def letter_places(spark, sf_dir):
    """Written tokens resolved in the scale of their order."""
    token = F.get(F.array(*[F.lit(x) for x in _LETTERS]), (F.col("l_partkey") % len(_LETTERS)).cast("int"))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", token.alias("token"), (F.col("l_orderkey") % 72 + 1).cast("int").alias("mela"))
    return t.join(F.broadcast(music.melakartas(spark).select("mela", "labels")), "mela").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "token", scales.resolve_letter(F.col("token"), F.col("labels")).cast("int").alias("pos"))


@query("with k(pitch, semitone, label) as (values " + ", ".join(f"('{p}', {n}, '{p} · {k} kattai')" for n, (p, k) in enumerate(scales.KATTAI.items())) + ") select * from k")
def kattai_labels(spark, sf_dir):
    return scales.kattai_table(spark)


@query(f"""with {_LINES}, w as (select l_orderkey, list_transform(a, lambda x: {_BARE.format('x')}) as a, list_transform(d, lambda x: {_BARE.format('x')}) as d from s) select l_orderkey, len(list_filter(a, lambda x: not list_contains(d, x))) = 0 as inside from w""")
def marks_subset(spark, sf_dir):
    """Whether all labels of the ascent stand in the descent."""
    return scale_lines(spark, sf_dir).select("l_orderkey", scales.is_subset(F.transform("ascent", scales.bare), F.transform("descent", scales.bare)).alias("inside"))


# Talas.
RAW = [
    "Adi tala", "aadi", "Khanda Triputa", "Chaturasra Triputa", "miśra cāpu", "Misra Chapu (2 kalai)", "Rupakam", "roopakam talam", "Khanda Ata", "kanda jati eka tala", "Tisra Rupaka", "Sankeerna Jhampa",
    "Dhruva", "Matyam jathi", "unknown", "", "Mishra  Ekam", "desadi", "Eka tal", "khanda nadai Adi",
]
SHORT = ["adi", "khandajatitriputa", "misrajatieka", "ekatala", "caturasrajatirupaka", "misracapu", "khandacapu", "samkirnacapu", "tisracapu", "dhruvatala", "mathya", "jhampa", "sankirnajatiata", "none", "ata", "adijati", "chatusracapu"]


def _raw(spark, sf_dir, values):
    """A written value for each part. The table is one small file and what is made of its rows is dear, so they are dealt out."""
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", each=1 << 18).select("p_partkey", F.get(F.array(*[F.lit(x) for x in values]), (F.col("p_partkey") % len(values)).cast("int")).alias("raw"))


_CLEANED = r"regexp_replace(regexp_replace(raw, '\(.*?\)', ' ', 'g'), '(?i)\b(jati|jathi|talam?|nadai)\b', ' ', 'g')"


@query(f"""with r as (select p_partkey, {_list(RAW)}[p_partkey % {len(RAW)} + 1] as raw from part), v as (select distinct raw from r),
  c as (select raw, {_CLEANED} as cleaned from v), w as (select *, list_filter(regexp_split_to_array(trim(cleaned), '\\s+'), lambda x: x <> '') as ws from c),
  k as (select *, {_FOLD.format('cleaned')} as letters, {_phon('cleaned')} as sound, ws[1] as w1, array_to_string(ws[2:], '') as rest from w),
  j as (select *, {_map(talas.JATHIS)}[{_phon('w1')}] as jathi, {_map(talas.by_sound(talas.TALAS))}[{_phon('rest')}] as base from k),
  m as (select raw, coalesce({_map(talas.TALAS)}[letters], {_map(talas.by_sound(talas.TALAS))}[sound], case when len(ws) >= 2 and jathi is not null and base is not null then
    case when jathi = 'Chaturasra' and base = 'Triputa' then 'Adi' when base in {tuple(talas.TAKES_JATHI)} then jathi || ' ' || base else base end end) as tala from j)
  select p_partkey, r.raw, tala from r join m on r.raw = m.raw""")
def tala_match(spark, sf_dir):
    """Talas as written to their usual names."""
    return _raw(spark, sf_dir, RAW).withColumn("tala", talas.match_tala(F.col("raw")))


def _first(column: str, choices: dict, test: str) -> str:
    return "coalesce(" + ", ".join(f"case when {test.format(column, k)} then {v} end" for k, v in choices.items()) + ")"


_BY_LENGTH = {k: f"'{k}'" for k in sorted(talas.STRUCTURE, key=lambda x: -len(x))}
_ANGAS = {k: "[" + ", ".join("laghu" if a == "L" else a for a in v) + "]" for k, v in talas.STRUCTURE.items()}
_TALA_SQL = f"""v as (select unnest({_list(SHORT)}) as raw), n as (select raw, regexp_replace(regexp_replace(lower(raw), '[^a-z]', '', 'g'), '(talam|tala|tal)$', '') as n from v),
  f as (select *, {_first('n', _BY_LENGTH, "contains({}, '{}')")} as fam, {_first('n', {k: talas.JATI[k] for k in sorted(talas.JATI, key=lambda x: -len(x))}, "contains({}, '{}')")} as jati from n),
  l as (select *, coalesce(jati, {_map(talas.USUAL)}[fam]) as laghu from f),
  g as (select raw, case when contains(n, 'capu') then 'capu' when contains(n, 'adi') and not contains(n, 'jati') then 'adi' else fam end as family,
    case when contains(n, 'capu') then coalesce({_first('n', {k: f'[{v}]' for k, v in talas.CHAPU.items()}, "contains({}, '{}')")}, {_first('n', {k: f'[{v // 2}, {v - v // 2}]' for k, v in talas.JATI.items()}, "starts_with({}, '{}')")})
      when contains(n, 'adi') and not contains(n, 'jati') then [4, 2, 2] when fam is not null then {_first('fam', _ANGAS, "{} = '{}'")} end as angas from l),
  s as (select raw, family, angas, list_sum(angas)::int as total, {_map(talas.JATI_NAMES)}[case when family = 'rupaka' then angas[2] else angas[1] end] || ' ' || {_map(talas.FAMILY_NAMES)}[family] || ' — ' || list_sum(angas)::int || ' beats' as label from g)"""


@query(f"with {_TALA_SQL} select p_partkey, s.raw, family, array_to_string(angas, ' ') as angas, total, label from (select p_partkey, {_list(SHORT)}[p_partkey % {len(SHORT)} + 1] as raw from part) p join s using (raw)")
def tala_angas(spark, sf_dir):
    """Angas, beats and label of talas by name."""
    n = F.col("raw")
    return _raw(spark, sf_dir, SHORT).select("p_partkey", "raw", talas.family(n).alias("family"), F.array_join(talas.angas(n).cast("array<string>"), " ").alias("angas"), talas.total(n).alias("total"), talas.engine_label(n).alias("label"))


@query(f"""with {_TALA_SQL}, d as (select raw, case when family = 'adi' or contains(raw, 'adi') and not contains(raw, 'jati') then 'Adi' when starts_with(label, 'Chaturasra Eka') then 'Chaturasra Eka'
    when label is null and contains(raw, 'capu') then (case when contains(raw, 'khanda') then 'Khanda Chapu' else raw end) else coalesce(label, raw) end as shown from s),
  x as (select *, regexp_extract(shown, '^({"|".join(talas.JATI_NAMES.values())}) ({"|".join(talas.FAMILY_NAMES.values())})( — \\d+ beats)?$', ['jathi', 'tala', 'b']) as m from d)
  select p_partkey, shown, case when shown = 'Adi' then 'Triputa' else nullif(m.tala, '') end as tala, case when shown = 'Adi' then 'Chaturasra' else nullif(m.jathi, '') end as jathi
  from (select p_partkey, {_list(SHORT)}[p_partkey % {len(SHORT)} + 1] as raw from part) p join x using (raw)""")
def tala_labels(spark, sf_dir):
    """What is shown for a tala, and the tala and jathi that bars come from."""
    d = _raw(spark, sf_dir, SHORT).withColumn("shown", talas.display_tala(F.col("raw")))
    return d.select("p_partkey", "shown", talas.tala_and_jathi(F.col("shown")).alias("t")).select("p_partkey", "shown", "t.tala", "t.jathi")


# Names.
_NAMED = "select name, min(k) as ord from (select case when p_partkey % 2 = 0 then p_name else 'x' || p_name end as name, p_partkey as k from part) group by 1"
_WRITTEN = "case p_partkey % 5 when 0 then upper(p_name) when 1 then p_type || '(' || p_name || '/nothing)' when 2 then p_name || 'm' when 3 then replace(p_name, 'i', 'ee') || ' (none)' else p_brand end"


@query(f"""with n as ({_NAMED}), q as (select p_partkey, {_WRITTEN} as raw from part), d as (select distinct raw from q), o as (select raw, regexp_replace(raw, '\\([^)]*\\)', '', 'g') as outer_, regexp_extract_all(raw, '\\(([^)]*)\\)', 1) as inner_ from d),
  e as (select raw, list_filter(list_transform(list_concat([outer_], flatten(list_transform(inner_, lambda x: string_split(x, '/'))), string_split(outer_, '/')), lambda x: trim(x)), lambda x: x <> '') as c from o),
  f as (select raw, list_concat(c, flatten(list_transform(c, lambda x: case when ends_with(x, 'm') then [x || 'm', left(x, length(x) - 1)] else [x || 'm'] end))) as c from e),
  g as (select raw, unnest(c) as c, unnest(range(len(c))) as k from f), h as (select raw, k, {_FOLD.format('c')} as letters, {_phon('c')} as sound from g),
  x1 as (select {_FOLD.format('name')} as key, arg_min(name, ord) as name from n group by 1), x2 as (select {_phon('name')} as key, min(name) as name from n group by 1 having count(distinct name) = 1),
  a as (select raw, 1 as tier, k, name from h join x1 on letters = key union all select raw, 2, k, name from h join x2 on sound = key), b as (select raw, min(struct_pack(tier := tier, k := k, name := name)) as m from a group by 1)
  select p_partkey, q.raw, m.name as match, m.tier::int as tier from q left join b on q.raw = b.raw""")
def name_match(spark, sf_dir):
    """Names as written, with brackets and alternatives, to those of a table."""
    part = table(spark, sf_dir, "part")
    n = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("x"), "p_name")).alias("name"), F.col("p_partkey").alias("k")).groupBy("name").agg(F.min("k").alias("ord"))
    return records.match_names(part.select("p_partkey", F.expr(_WRITTEN.replace("ends_with", "endswith")).alias("raw")), n).select("p_partkey", "raw", "match", "tier")


_ALIASED = ["Todi", "Pantuvarali", "natai", "Kalyani", "Mecha Kalyani", "Sankarabharanam", "Mohanam"]


@query(f"""with q as (select p_partkey, {_list(_ALIASED)}[p_partkey % {len(_ALIASED)} + 1] as name from part) select p_partkey, name, coalesce({_map({names.plain_scale_key(a): names.plain_scale_key(b) for a, b in names.SCALE_ALIASES.items()})}[k], k) as key
  from (select *, regexp_replace({_rewritten(_FOLD.format('name'), names.SCALE_NAMES)}, '(am|a|i|u|m)$', '') as k from q)""")
def alias_keys(spark, sf_dir):
    """Keys of scales' names, aliases resolved."""
    return _raw(spark, sf_dir, _ALIASED).select("p_partkey", F.col("raw").alias("name"), names.resolved_key(F.col("raw")).alias("key"))


_CELLS = ["[[Todi|Hanumatodi]]<ref name=x>y</ref>", "'''Mohanam''' {{note|x}} more", "[[Kalyani]]<br/>తెలుగు", "Nīḷāṃbari కల్యాణి  రాగం", "<i>Bhairavi</i> | ", "plain text"]


@query(f"""with q as (select p_partkey, {_list(_CELLS)}[p_partkey % {len(_CELLS)} + 1] as cell from part), v as (select distinct cell from q),
  s as (select cell, {"regexp_replace(" * 9}cell, '(?is)<ref[^>]*>.*?</ref>', '', 'g'), '(?i)<ref[^>]*/>', '', 'g'), '(?is)<br\\s*/?>.*$', '', 'g'), '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g'), '\\[\\[[^\\]|]*\\|([^\\]]*)\\]\\]', '\\1', 'g'), '\\[\\[([^\\]]*)\\]\\]', '\\1', 'g'), '<[^>]+>', '', 'g'), '''''''', '', 'g'), '''''', '', 'g') as c from v),
  w as (select cell, list_filter(regexp_split_to_array(trim(c), '\\s+'), lambda x: x <> '' and not (length(regexp_replace(x, '\\P{{L}}', '', 'g')) > 0 and length(regexp_replace(regexp_replace(x, '[^\\x{{0900}}-\\x{{0DFF}}]', '', 'g'), '\\P{{L}}', '', 'g')) >= 0.6 * length(regexp_replace(x, '\\P{{L}}', '', 'g')))) as ws from s)
  select p_partkey, trim(array_to_string(ws, ' '), ' |' || chr(9)) as plain from q join w using (cell)""")
def plain_cells(spark, sf_dir):
    """Wiki cells as readable text."""
    return _raw(spark, sf_dir, _CELLS).select("p_partkey", records.plain_cell(F.col("raw")).alias("plain"))


_WIKI = ["| x || {{svaraC|S|R1|G3|title=a|M1|P}} ||", "{{svaraC | S | R’ }}", "{{svaraC|S|Q9}}", "no template", "{{svaraC|N2'|D1.|S}}"]


@query(f"""with q as (select p_partkey, {_list(_WIKI)}[p_partkey % {len(_WIKI)} + 1] as cell from part), i as (select *, regexp_extract(cell, '(?s)\\{{\\{{\\s*svaraC\\s*\\|(.*?)\\}}\\}}', 1) as x from q),
  t as (select p_partkey, list_filter(list_transform(string_split(x, '|'), lambda y: replace(trim(y), '’', '''')), lambda y: y <> '' and not contains(y, '=')) as ts from i)
  select p_partkey, case when len(ts) > 0 and len(list_filter(ts, lambda y: not list_contains({_list(scales.PITCH)}, {_BARE.format('y')}))) = 0 then array_to_string(ts, ' ') end as tokens from t""")
def template_tokens(spark, sf_dir):
    return _raw(spark, sf_dir, _WIKI).select("p_partkey", F.array_join(records.template_tokens(F.col("raw")), " ").alias("tokens"))


_HEADS = [["Kriti", "Rāga", "Talam", "Notes"], ["Song", "raga", "raagam", "Temple"], ["No.", "Name", "Language", "god"]]


@query(f"""with q as (select p_partkey, {[h for h in _HEADS]}[p_partkey % 3 + 1] as h, [p_name, p_type, p_brand, p_size::varchar] as c from part),
  e as (select p_partkey, unnest(range(1, 5)) as i, h, c from q), k as (select p_partkey, i, {_map(records.HEADERS)}[lower(trim(regexp_replace(h[i], '[^\\p{{L}} ]', '', 'g')))] as k, c[i] as v from e),
  f as (select p_partkey, k, arg_min(v, i) as v from k where k is not null group by all) select p_partkey, string_agg(k || '=' || v, ';' order by k) as fields from f group by 1""")
def header_columns(spark, sf_dir):
    """Cells by what their headings mean."""
    heads = F.get(F.array(*[F.array(*[F.lit(x) for x in h]) for h in _HEADS]), (F.col("p_partkey") % 3).cast("int"))
    m = records.columns_by_header(heads, F.array("p_name", "p_type", "p_brand", F.col("p_size").cast("string")))
    d = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return d.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat_ws("=", k, F.col("m")[k])), ";").alias("fields"))


_TEXTS = ["\n  INTHA CHALAMU\nRagam: Begada  Tala\nMeaning : x", "Evvari bodhana\nragam Abhogi\n", "", "   \nTITLE ONLY"]


@query(f"""with q as (select p_partkey, [{', '.join("replace('" + t.replace(chr(10), '~') + "', '~', chr(10))" for t in _TEXTS)}][p_partkey % 4 + 1] as t, p_name from part),
  x as (select *, regexp_extract(t, '(?im)^\\s*ragam\\s*:?\\s*(.+)$', 1) as r, coalesce(nullif(trim(regexp_extract(t, '(?m)^[ \\t]*(\\S.*)$', 1)), ''), p_name, '') as f from q)
  select p_partkey, nullif(trim(regexp_replace(r, '\\s+', ' ', 'g')), '') as ragam, case when upper(f) = f and lower(f) <> f then array_to_string(list_transform(string_split(lower(f), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else f end as title from x""")
def text_headers(spark, sf_dir):
    """Titles and labelled fields of texts."""
    d = _raw(spark, sf_dir, _TEXTS).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return d.select("p_partkey", records.header_field(F.col("raw"), "ragam").alias("ragam"), records.title_of(F.col("raw"), F.col("p_name")).alias("title"))


KINDS = ["kirtana", "gita", "svarajati", "tanavarnam", "varnam", "tana"]
_PIECES = ["1 kīrtana — ādi tāḷa — x", "gita — rupaka tala", "something — eka tala", "prose without", "varnam — Dikshitar", "kırtana — tala adi"]


@query(f"""with q as (select p_partkey, {_list(_PIECES)}[p_partkey % {len(_PIECES)} + 1] as raw from part), s as (select *, string_split(raw, '—') as p from q),
  f as (select *, {_FOLD.format("replace(p[1], 'ı', 'i')")} as head, {_FOLD.format("coalesce(p[2], '')")} as tala from s), k as (select *, {_first('head', {k: f"'{k}'" for k in KINDS}, "contains({}, '{}')")} as kind from f)
  select p_partkey, case when len(p) >= 2 then coalesce(kind, case when contains(tala, 'tala') and head <> '' then 'other' end) end as kind, case when len(p) >= 2 and (kind is not null or contains(tala, 'tala') and head <> '') then case when contains(tala, 'tala') then tala else '' end end as tala from k""")
def header_kinds(spark, sf_dir):
    """Kinds and talas of printed headers."""
    h = records.header_kind(F.col("raw"), KINDS)
    return _raw(spark, sf_dir, _PIECES).select("p_partkey", h["kind"].alias("kind"), h["tala"].alias("tala"))


# Records.
LABELS = ["Pallavi", "Caraṇam sahānā", "Violin alap", "alap kāpi", "applause", "Melkalam", "  Anupallavi  kāpi raga ", "Nereval"]


def _named(key: str) -> str:
    c, p = _map(records.COMPOSITION), _map(records.PERFORMANCE)
    return f"case when {c}[{key}] is not null then {c}[{key}] else {p}[{key}] end, case when {c}[{key}] is not null then 'composition' when {p}[{key}] is not null then 'performance' end"


@query(f"""with q as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_list(LABELS)}[l_partkey % {len(LABELS)} + 1] as label from lineitem), v as (select distinct label from q),
  w as (select label, list_filter(regexp_split_to_array(trim(label), '\\s+'), lambda x: x <> '') as ws from v), k as (select label, {_FOLD.format('label')} as whole, ws[1] as w1, array_to_string(ws[2:], ' ') as rest, len(ws) as n from w),
  h as (select *, {_FOLD.format('w1')} as head from k), a as (select label, rest, n, list_value({_named('whole')}) as x, list_value({_named('head')}) as y from h),
  r as (select label, coalesce(x[1], case when n > 1 then y[1] end, trim(label)) as name, coalesce(x[2], case when n > 1 then y[2] end, 'other') as kind, case when x[1] is null and n > 1 and y[1] is not null then rest end as scale from a)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, name, kind, scale from q join r using (label)""")
def section_kinds(spark, sf_dir):
    """What section labels name."""
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("l_partkey") % len(LABELS)).cast("int"))
    c = records.classify_section(F.col("label"))
    return table(spark, sf_dir, "lineitem").withColumn("label", label).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c["name"].alias("name"), c["kind"].alias("kind"), c["scale"].alias("scale"))


FILES = [*records.EVIDENCE, ".json", ".mp3.mp3", ".sections-manual-p.txt"]
_FILES = f"f as (select l_orderkey as dir, l_orderkey || '/' || l_linenumber || {_list(FILES)}[(l_partkey * 7 + l_suppkey) % {len(FILES)} + 1] as path, (l_extendedprice * 1000)::bigint as bytes from lineitem)"


def _files(spark, sf_dir):
    end = F.get(F.array(*[F.lit(x) for x in FILES]), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % len(FILES)).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dir"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), end).alias("path"), (F.col("l_extendedprice") * 1000).cast("decimal(38,10)").alias("b")).select("dir", "path", F.round("b", 0).cast("long").alias("bytes"))


_HAS = ", ".join(f"bool_or(contains(path, '{k}')) as h{n}" for n, k in enumerate([*records.EVIDENCE, ".json"]))
_EVIDENCE = f"""{_FILES}, h as (select dir, {_HAS} from f group by 1),
  e as (select dir, ({' + '.join(f'{w} * h{n}::int' for n, w in enumerate(records.EVIDENCE.values()))})::int as score, h3 and (h4 or h1) as usable, h6 and (h5 or h2) as annotated from h)"""


@query(f"with {_EVIDENCE} select * from e")
def track_evidence(spark, sf_dir):
    """What the files of each order show."""
    return records.track_evidence(_files(spark, sf_dir), "dir", "path")


@query(f"with {_EVIDENCE} select dir, score from e where usable order by score desc, dir limit 25")
def select_tracks(spark, sf_dir):
    """The 25 usable records with most evidence: a top-k."""
    return records.select_tracks(records.track_evidence(_files(spark, sf_dir), "dir", "path"), "dir", 25).select("dir", "score")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderkey limit 100")
def first_records(spark, sf_dir):
    """The first hundred records that fulfil a filter: a limit that is the feature."""
    return records.limit_records(table(spark, sf_dir, "orders"), "o_orderkey", 100, F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("select clip_id, i, t_s from (select user_id as clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, ((row_number() over (partition by user_id order by ts, event_id) - 1) * 256 + 400.0::double) / 16000 as t_s from events) where t_s <= 0.5")
def trimmed_contour(spark, sf_dir):
    from tessitura.plans.catalogue import frames

    return records.trim_contour(frames(spark, sf_dir).withColumn("t_s", music.frame_time(F.col("i"))), 0.5).select("clip_id", "i", "t_s")


@query("select * from (select 'c' as corpus, c_custkey::bigint as id, c_name as title, c_acctbal as level from customer union all select 's', s_suppkey, s_name, null from supplier)")
def scan_all(spark, sf_dir):
    """Two corpora under one another."""
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("corpus"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("level"))
    return records.scan_all(c, table(spark, sf_dir, "supplier").select(F.lit("s").alias("corpus"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("title")))


_PATHS = "select 'r/' || (l_orderkey % 7) || '/' || (l_orderkey % 31) || '/' || l_orderkey || '/' || l_linenumber || '.pitch' as path from lineitem where l_linenumber = 1"
_TONICS = "select distinct case l_orderkey % 3 when 0 then 'r/' || (l_orderkey % 7) || '/tonic.txt' when 1 then 'r/' || (l_orderkey % 7) || '/' || (l_orderkey % 31) || '/tonic.txt' else 'r/' || (l_orderkey % 7) || '/' || (l_orderkey % 31) || '/' || l_orderkey || '/tonic.txt' end as path from lineitem where l_orderkey % 5 = 0 and l_orderkey % 7 < 5"


@query(f"""with a as (select distinct path from ({_PATHS})), t as ({_TONICS}), f as (select regexp_replace(path, '/[^/]*$', '') as folder, path as found from t),
  j as (select a.path, arg_max(found, length(folder)) as found from a join f on starts_with(a.path, folder || '/') group by 1) select a.path, found from a left join j using (path)""")
def tonic_above(spark, sf_dir):
    """For each contour the tonic file in its folder or above."""
    li = table(spark, sf_dir, "lineitem")
    li.createOrReplaceTempView("lineitem_paths")
    paths = spark.sql(_PATHS.replace("from lineitem", "from lineitem_paths")).distinct()
    return records.nearest_above(spark.sql(_TONICS.replace("from lineitem", "from lineitem_paths")), paths)


_SPANS = f"{_NUMBERED}, sec as (select l_orderkey, sum(l_quantity) over (partition by l_orderkey order by n) - l_quantity as a, sum(l_quantity) over (partition by l_orderkey order by n) as b from u)"


@query(f"""with {_SPANS}, c as (select l_orderkey, b - a as d, a, b, unnest([1, 2, 3]) as f from sec where b - a >= 16), t as (select *, a + 6 + (b - a - 10) * ([0.15, 0.45, 0.7]::double[])[f] as s from c),
  o as (select *, row_number() over (partition by l_orderkey order by d desc, a, f) as r from t where s + 10 <= b), w as (select l_orderkey, list(s order by r) as l from o group by 1),
  z as (select l_orderkey, list_filter(range(1, len(l) + 1), lambda i: true) as idx, l from w),
  acc as (with recursive g(l_orderkey, l, i, kept) as (select l_orderkey, l, 1, []::double[] from z union all select l_orderkey, l, i + 1, case when len(list_filter(kept, lambda u: abs(l[i] - u) <= 5)) = 0 then list_append(kept, l[i]) else kept end from g where i <= len(l)) select l_orderkey, kept from g where i > len(l))
  select l_orderkey, unnest(range(least(4, len(kept))))::int as k, round(unnest(kept[:4]), 6) as start_s from acc""")
def excerpt_starts(spark, sf_dir):
    """Places for excerpts of ten seconds in each order's sections."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("n")
    d = numbered(spark, sf_dir).withColumn("end_s", F.sum("l_quantity").over(w)).withColumn("start_s", F.col("end_s") - F.col("l_quantity"))
    return records.excerpt_candidates(d, "l_orderkey", 10.0).select("l_orderkey", "k", F.round("start_s", 6).alias("start_s"))


@query("""with c as (select o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k, o_orderkey as start_s, -(o_totalprice / 3000) as level from orders)
  select o_custkey, coalesce(arg_min(start_s, k) filter (level > -50), arg_max(start_s, k)) as start_s, round(coalesce(arg_min(level, k) filter (level > -50), arg_max(level, k)), 6) as level from c where k <= 4 group by 1""")
def first_audible(spark, sf_dir):
    """The first of at most four candidates that isn't silent."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    c = table(spark, sf_dir, "orders").select("o_custkey", k.alias("k"), F.col("o_orderkey").alias("start_s"), (-F.col("o_totalprice") / 3000).alias("level")).filter("k <= 4")
    return records.first_audible(c, "o_custkey").select("o_custkey", "start_s", F.round("level", 6).alias("level"))


@query(f"with {_FILES}, s as (select {_list(FILES)}[(l_partkey * 7 + l_suppkey) % {len(FILES)} + 1] as kind, (l_extendedprice * 1000)::bigint as bytes from lineitem) select kind, count(*) as files, sum(bytes)::bigint as bytes from s group by 1")
def size_totals(spark, sf_dir):
    """Sizes by kind of file."""
    return records.size_totals(_files(spark, sf_dir), F.regexp_extract("path", r"^\d+/\d+(\..*)$", 1)).select("kind", "files", "bytes")


@query("select p_partkey as id, p_name as title from part order by case when p_size < 10 then p_size end nulls last, p_name, p_partkey limit 60")
def library_order(spark, sf_dir):
    """The first sixty pieces of the library: a limit that is the feature."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") < 10, F.col("p_size")).alias("notation_rank"))
    return records.library_order(p, 60).select("id", "title")
