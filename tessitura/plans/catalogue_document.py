"""Notation documents, audits, practice and sinks bound to the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import music
from tessitura.functions.names import phonetic_key
from tessitura.operators import audit, document, kernels, library
from tessitura.operators import frames as fr
from tessitura.operators.staging import shared_folder
from tessitura.plans.catalogue import CONTOUR, FRAMES, NOTES, TONIC, decoded, frames, query, table
from tessitura.plans.catalogue_library import _list, _phon
from tessitura.plans.catalogue_notation import _NUMBERED, numbered
from tessitura.streaming import practice

_TOKENS = ["S", "R^", "G", ",", "M_", "P^^", "D", "N__"]


@query(f"""with {_NUMBERED} select l_orderkey, n::int - 1 as k, substr({_list(_TOKENS)}[(l_partkey % 8) + 1], 1, 1) as letter, case when length({_list(_TOKENS)}[(l_partkey % 8) + 1]) > 1 then
   (length({_list(_TOKENS)}[(l_partkey % 8) + 1]) - 1) * case when contains({_list(_TOKENS)}[(l_partkey % 8) + 1], '_') then -1 else 1 end end::int as octave from u""")
def flat_tokens(spark, sf_dir):
    """An order's tokens in cycles of four in divisions of two, flat again."""
    tok = F.get(F.array(*[F.lit(t) for t in _TOKENS]), (F.col("l_partkey") % 8).cast("int"))
    d = numbered(spark, sf_dir).withColumn("tok", tok)
    div = d.groupBy("l_orderkey", F.floor((F.col("n") - 1) / 4).alias("c"), F.floor((F.col("n") - 1) / 2).alias("d")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "tok"))), lambda x: x["tok"]).alias("t"))
    cyc = div.groupBy("l_orderkey", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "t"))), lambda x: x["t"]).alias("t"))
    whole = cyc.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]).alias("cycles"))
    return whole.select("l_orderkey", F.posexplode(document.flat_tokens(F.col("cycles"))).alias("k", "t")).select("l_orderkey", "k", "t.letter", "t.octave")


_ROWS = f"""{_NUMBERED}, rows as (select l_orderkey, ((n - 1) // 3)::int as section, 'part ' || ((n - 1) // 3) as name, ((n - 1) % 3)::int as pos, substr('SRGMPDN', (l_partkey % 7)::int + 1, 1) as s, ((l_suppkey % 3) - 1)::int as o, l_quantity as d, case when l_linenumber % 2 = 0 then 'la' || l_linenumber end as syl from u)"""


def notation_rows(spark, sf_dir):
    """(l_orderkey, section, name, pos, s, o, d, syl): an order's lines as svaras, three a section."""
    d = numbered(spark, sf_dir)
    section = F.floor((F.col("n") - 1) / 3).cast("int")
    return d.select("l_orderkey", section.alias("section"), F.concat(F.lit("part "), section.cast("string")).alias("name"), ((F.col("n") - 1) % 3).cast("int").alias("pos"), F.substr(F.lit("SRGMPDN"), (F.col("l_partkey") % 7).cast("int") + 1, F.lit(1)).alias("s"),
                    ((F.col("l_suppkey") % 3) - 1).cast("int").alias("o"), F.col("l_quantity").alias("d"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("la"), F.col("l_linenumber").cast("string"))).alias("syl"))


@query(f"with {_ROWS} select l_orderkey, section, name, pos, s, o, d, syl from rows")
def document_rows(spark, sf_dir):
    """Notation documents built and read back."""
    return document.document_rows(document.documents(notation_rows(spark, sf_dir), "l_orderkey", F.lit("Adi"), F.lit(1)), "l_orderkey")


@query(f"with {_ROWS} select l_orderkey, section, name, pos, s, o, d, syl from rows")
def contributed_rows(spark, sf_dir):
    """Contributed pieces, whose svaras all stand in one entry with marks where sections start, read back to the same rows."""
    return document.document_rows(document.contributed(notation_rows(spark, sf_dir), "l_orderkey"), "l_orderkey")


@query(f"""with {_ROWS} select l_orderkey, string_agg(s || case when o > 0 then repeat('''', o) when o < 0 then repeat('.', -o) else '' end, ' ' order by section, pos) as flat, count(distinct section)::int as sections, count(syl) as syllables from rows group by 1""")
def contributed_flat(spark, sf_dir):
    d = document.contributed(notation_rows(spark, sf_dir), "l_orderkey")
    size = lambda p: F.size(F.regexp_extract_all("document", F.lit(p), F.lit(0)))
    return d.select("l_orderkey", "flat", size('"sectionStart"').alias("sections"), size('"syl"').cast("long").alias("syllables"))


@query(f"with {_ROWS} select l_orderkey, 'two halves' as structure, count(distinct section)::int as sections from rows group by 1")
def document_structure(spark, sf_dir):
    """Documents with a field put in."""
    d = document.with_structure(document.documents(notation_rows(spark, sf_dir), "l_orderkey", F.lit("Adi"), F.lit(1)), F.lit("two halves"))
    d = d.select("l_orderkey", F.from_json("document", "structure string, sections array<struct<name:string>>").alias("d"))
    return d.select("l_orderkey", "d.structure", F.size("d.sections").alias("sections"))


@query("""select event_id, case event_id % 6 when 0 then 'n' || event_id when 1 then 'a' || event_id when 2 then 's' || event_id when 3 then 't' || event_id when 4 then (event_id % 9)::varchar end as value from events""")
def metadata_first(spark, sf_dir):
    """Metadata that is a text, a list or an object."""
    i = F.col("event_id")
    raw = F.when(i % 6 == 0, F.concat(F.lit('{"name":"n'), i, F.lit('","id":1}'))).when(i % 6 == 1, F.concat(F.lit('["a'), i, F.lit('","b"]'))).when(i % 6 == 2, F.concat(F.lit('"s'), i, F.lit('"'))).when(i % 6 == 3, F.concat(F.lit('[{"title":"t'), i, F.lit('"}]'))).when(i % 6 == 4, (i % 9).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", document.first_value(raw).alias("value"))


_TIMED = NOTES + ", k as (select clip_id, idx, dur, case when idx % 5 in (0, 1) then idx // 5 end as grp, greatest(0, least(7, floor(dur / 0.032 + 0.5) - 1))::int as commas from notes)"


@query(f"""with {_TIMED}, u as (select clip_id, min(idx) as first, count(*) as notes, case when any_value(grp) is not null then 1.0 else 1.0 + any_value(commas) end / 2.0 as beats from k group by clip_id, coalesce('g' || grp, 'n' || idx))
  select clip_id, (row_number() over (partition by clip_id order by first) - 1)::int as unit, first, notes, beats::double as beats from u""")
def note_units(spark, sf_dir):
    """Units of beats at second speed: pairs share a beat."""
    n = decoded(spark, sf_dir).select("clip_id", "idx", F.when(F.col("idx") % 5 <= 1, F.floor(F.col("idx") / 5)).alias("grp"), library.comma_count(F.col("dur"), F.lit(0.032), F.lit(None).cast("int")).alias("commas"))
    return document.units(n, "clip_id", "idx", "grp", "commas", 2.0)


@query(f"""with {NOTES}, d as (select clip_id, idx, dur * (1 + idx % 4) as dur, idx % 11 = 5 as transit from notes), r as (select *, row_number() over (partition by clip_id order by idx) as k from d where not transit),
  m as (select *, median(dur) over (partition by clip_id order by k rows between 4 preceding and 4 following exclude current row) as mid from r), f as (select *, coalesce(dur < 0.7 * mid, false) as fast from m),
  g as (select *, sum(case when fast and coalesce(before, false) then 0 else 1 end) over (partition by clip_id order by k) as run from (select *, lag(fast) over (partition by clip_id order by k) as before from f)),
  c as (select *, (row_number() over (partition by clip_id, run order by k) - 1) // 4 as cut from g where fast), z as (select clip_id, idx, count(*) over (partition by clip_id, run, cut) as size, min(idx) over (partition by clip_id, run, cut) as beat_group from c)
  select d.clip_id, d.idx, z.beat_group from d left join z on z.clip_id = d.clip_id and z.idx = d.idx and z.size >= 2""")
def fast_groups(spark, sf_dir):
    """Runs of fast notes grouped to beats."""
    n = decoded(spark, sf_dir).select("clip_id", "idx", (F.col("dur") * (1 + F.col("idx") % 4)).alias("dur"), (F.col("idx") % 11 == 5).alias("transit"))
    return document.group_fast(n, "clip_id", "idx", "dur", "transit").select("clip_id", "idx", "beat_group")


@query(f"""with {NOTES}, d as (select clip_id, idx, idx % 3 = 0 as transit from notes where idx % 4 <> 2), i as (select *, (row_number() over (partition by clip_id order by idx) - 1)::int as k from d),
  a as (select clip_id, case when clip_id % 3 = 0 then null else clip_id % 3 * 2 end as anchor from frames group by 1), f as (select clip_id, min(idx) filter (not transit) as first from d group by 1), b as (select clip_id, coalesce(anchor, first) as anchor from a left join f using (clip_id))
  select b.clip_id, case when i.k is not null then b.anchor end::bigint as anchor, i.k as index from b left join i on i.clip_id = b.clip_id and i.idx = b.anchor""")
def anchor_places(spark, sf_dir):
    """Where anchors stand after notes are deleted."""
    n = decoded(spark, sf_dir).filter("idx % 4 <> 2").select("clip_id", "idx", (F.col("idx") % 3 == 0).alias("transit"))
    a = frames(spark, sf_dir).select("clip_id").distinct().withColumn("anchor", F.when(F.col("clip_id") % 3 != 0, F.col("clip_id") % 3 * 2).cast("long"))
    return document.anchor_index(n, a, "clip_id", "idx", "transit")


@query(f"""with {NOTES}, n as (select clip_id, idx, label, 0 as commas, 'la' as syl from notes), e as (select clip_id, idx, case when idx % 3 = 0 then 'S' end as label, case when idx % 2 = 0 then 2 end as commas, case when idx % 5 = 0 then 'ti' end as syl, idx % 7 = 0 as clear_syl, idx % 11 = 0 as deleted from notes where idx % 3 < 2)
  select n.clip_id, n.idx, coalesce(e.label, n.label) as label, coalesce(e.commas, n.commas)::int as commas, case when coalesce(clear_syl, false) then null else coalesce(e.syl, n.syl) end as syl, coalesce(e.label <> n.label, false) as edited
  from n left join e using (clip_id, idx) where not coalesce(deleted, false)""")
def corrected_notes(spark, sf_dir):
    """Notes with manual corrections."""
    d = decoded(spark, sf_dir).select("clip_id", "idx", "label")
    i = F.col("idx")
    e = d.filter("idx % 3 < 2").select("clip_id", "idx", F.when(i % 3 == 0, "S").alias("label"), F.when(i % 2 == 0, 2).alias("commas"), F.when(i % 5 == 0, "ti").alias("syl"), (i % 7 == 0).alias("clear_syl"), (i % 11 == 0).alias("deleted"))
    return document.corrected(d.withColumn("commas", F.lit(0)).withColumn("syl", F.lit("la")), e, ["clip_id", "idx"], ["label", "commas", "syl"])


@query("""with s as (select l_orderkey, l_returnflag, count(*)::int as svaras, trim(repeat('la ', (l_orderkey % 4)::int)) as typed from lineitem group by 1, 2) select l_orderkey, l_returnflag, svaras, (l_orderkey % 4) = 0 or (l_orderkey % 4) = svaras as ok from s""")
def syllable_check(spark, sf_dir):
    """Whether sections have a syllable for each svara, where any are typed."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").cast("int").alias("svaras")).withColumn("typed", F.trim(F.repeat(F.lit("la "), (F.col("l_orderkey") % 4).cast("int"))))
    return document.syllables_match(s, "typed", "svaras").select("l_orderkey", "l_returnflag", "svaras", "ok")


@query("""with s as (select o_orderkey, count(distinct l_returnflag) as sections, coalesce(bool_or(l_discount > 0.05), false) as sahitya, count(l_orderkey) as svaras from orders left join lineitem on l_orderkey = o_orderkey group by 1)
  select o_orderkey, case when svaras = 0 then 'none' when sections > 1 and sahitya then 'complete' else 'partial' end as completeness from s where svaras > 0 or o_orderkey % 2 = 0""")
def piece_completeness(spark, sf_dir):
    """How complete each piece is, those without notation of one half left out."""
    o, li = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem")
    s = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count_distinct("l_returnflag").alias("sections"), F.coalesce(F.bool_or(F.col("l_discount") > 0.05), F.lit(False)).alias("sahitya"), F.count("l_orderkey").alias("svaras"))
    d = s.withColumn("completeness", document.completeness(F.col("sections"), F.col("sahitya"), F.col("svaras")))
    return d.filter((F.col("completeness") != "none") | (F.col("o_orderkey") % 2 == 0)).select("o_orderkey", "completeness")


@query("""with old as (select p_partkey, p_name, p_brand, p_size from part where p_partkey % 3 <> 0), new as (select p_partkey + 5000000 as p_partkey, p_name, p_brand, 0 as p_size from part where p_partkey % 10 = 0)
  select p_partkey, p_name, p_brand, p_size from old where not exists (select 1 from new where new.p_name = old.p_name and new.p_brand = old.p_brand) and not starts_with(p_name, 'hot') union all select * from new""")
def replaced_rows(spark, sf_dir):
    """Rows deleted by key and put in anew, superseded titles gone."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    new = p.filter("p_partkey % 10 = 0").withColumn("p_partkey", F.col("p_partkey") + 5000000).withColumn("p_size", F.lit(0).cast(p.schema["p_size"].dataType))
    return document.replace_by_key(p.filter("p_partkey % 3 <> 0"), new, ["p_name", "p_brand"], "p_name", ("hot",))


@query()
def applied_suggestions(spark, sf_dir):
    """Notes with the labels of the clip after it where aligned and allowed."""
    n = decoded(spark, sf_dir).select("clip_id", "idx", "label")
    shifted = n.select((F.col("clip_id") - 1).alias("clip_id"), "idx", F.col("label").alias("suggested"))
    allowed = n.select("clip_id", "label").distinct().filter("label <> 'P'")
    return document.apply_suggestions(n, shifted, allowed, "clip_id", "idx").select("clip_id", "idx", "label", "edited")


# Sinks: written to the shared folder and read back.


def _folder(spark, name):
    return shared_folder(spark, name)


@query("select p_partkey, p_name, p_brand, p_size from part")
def json_sink(spark, sf_dir):
    """Rows written as JSON and read back."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    path = _folder(spark, "json")
    p.write.json(path)
    return spark.read.schema(p.schema).json(path)


@query(f"with {FRAMES} select clip_id, i, f0, conf, rms from frames where clip_id % 5 = 2")
def track_cache(spark, sf_dir):
    """Tracks cached as Parquet, a folder for each key, of which one is read."""
    path = _folder(spark, "tracks")
    f = frames(spark, sf_dir).select("clip_id", "i", "f0", "conf", "rms").withColumn("key", F.col("clip_id") % 5)
    f.write.partitionBy("key").parquet(path)
    return spark.read.parquet(path).filter("key = 2").drop("key")


@query("""select o_orderkey, o_custkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent_version, case when o_orderkey % 2 = 0 then 'first' else 'community' end as status from orders""")
def append_versions(spark, sf_dir):
    """Versions appended in two loads, never changed, each linked to the one before it."""
    path, o = _folder(spark, "versions"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o.filter("o_orderkey % 2 = 0").withColumn("status", F.lit("first")).write.mode("append").parquet(path)
    o.filter("o_orderkey % 2 = 1").withColumn("status", F.lit("community")).write.mode("append").parquet(path)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(w).alias("parent_version"), "status")


@query(f"""with new as (select {_phon('p_name')} as k, count(*)::int as sections from part where p_partkey % 4 = 0 group by 1), old as (select p_partkey, p_name, {_phon('p_name')} as k from part where p_partkey % 4 <> 0) select p_partkey, p_name, coalesce(sections, 0)::int as sections from old left join new using (k)""")
def section_update(spark, sf_dir):
    """Pieces updated by the phonetic key of their title."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name").withColumn("k", phonetic_key(F.col("p_name")))
    new = p.filter("p_partkey % 4 = 0").groupBy("k").agg(F.count("*").cast("int").alias("sections"))
    return p.filter("p_partkey % 4 <> 0").join(new, "k", "left").select("p_partkey", "p_name", F.coalesce("sections", F.lit(0)).alias("sections"))


# Audits.

_SEGS = f"{_NUMBERED}, s as (select l_orderkey, list(((l_quantity::int % 3) * 2 + 2)::double order by n) as segs from u group by 1)"


@query(f"""with {_SEGS}, a(k, j, cum) as (values (0, 0, 4), (0, 1, 6), (0, 2, 8)), t as (select l_orderkey, segs, list_sum(segs) as total, segs[1] as lead, list_transform(range(1, len(segs)), lambda i: round(list_sum(segs[:i]), 6)) as marks from s),
  o as (select *, unnest([1, 2, 4, 1, 2, 4]) as kal, unnest([0, 0, 0, 1, 1, 1]) as pickup from t), f as (select *, 8.0 * kal as cycle, case when pickup = 1 then 8.0 * kal - lead else 0 end as off from o where pickup = 0 or lead < 8.0 * kal),
  q as (select *, (total + off) / cycle as q from f), w as (select * from q where abs(q - floor(q + 0.5)) <= 1e-6 and floor(q + 0.5) >= 1),
  b as (select l_orderkey, marks, total, list_filter(flatten(list_transform(range(floor(q + 0.5)::int), lambda c: list_transform([4, 6, 8], lambda e: round(c * cycle + e * kal - off, 6)))), lambda x: x > 1e-6 and x < total - 1e-6) as want from w),
  r as (select l_orderkey, bool_or(len(want) > 0 and len(list_filter(want, lambda x: not list_contains(marks, x))) = 0) as ok from b group by 1) select s.l_orderkey, coalesce(ok, false) as ok from s left join r using (l_orderkey)""")
def marks_on_angas(spark, sf_dir):
    """Whether printed bars stand at the boundaries of Adi's angas."""
    seg = ((F.col("l_quantity").cast("int") % 3) * 2 + 2).cast("double")
    d = numbered(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", seg.alias("s")))), lambda x: x["s"]).alias("segs"))
    return d.select("l_orderkey", audit.marks_on_angas(F.col("segs"), F.array(F.lit(4), F.lit(2), F.lit(2))).alias("ok"))


@query("""with s as (select l_orderkey, l_returnflag, sum(l_quantity) * 4 as beats from lineitem group by 1, 2), w as (select l_orderkey, unnest([1, 2, 4]) as k, beats from s),
  a as (select l_orderkey, k, bool_and(abs(beats / (8.0 * k) - floor(beats / (8.0 * k) + 0.5)) < 1e-6 and floor(beats / (8.0 * k) + 0.5) >= 1) as ok from w group by 1, 2) select l_orderkey, coalesce(min(k) filter (ok), 1)::int as kalai from a group by 1""")
def kalai_of(spark, sf_dir):
    """The speed at which all sections are whole cycles."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg((F.sum("l_quantity") * 4).alias("beats"))
    return audit.kalai(s, "l_orderkey", "beats", F.lit(8.0))


@query("""with s as (select l_orderkey, l_shipdate, l_orderkey % 7 as family, l_quantity % 5 <> 0 as ok from lineitem), p as (select family, l_orderkey, bool_and(ok) as clean, count(*) as n, count(*) filter (ok) as good from s group by 1, 2)
  select family, count(*) as pieces, count(*) filter (clean) as clean, sum(n)::bigint as sections, sum(good)::bigint as ok from p group by 1""")
def audit_summary(spark, sf_dir):
    """Sections and pieces that are right, by family."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 7).alias("family"), (F.col("l_quantity") % 5 != 0).alias("ok"))
    return audit.audit(s, "l_orderkey", "family")


@query("select l_suppkey as page, l_quantity::int as miss, count(*) as n from lineitem where l_quantity % 5 = 0 group by 1, 2 having count(*) >= 4")
def hot_pages(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").filter("l_quantity % 5 = 0").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").cast("int").alias("miss"))
    return audit.hot_pages(m, "page", "miss")


@query("""with t as (select user_id, event_type, case when count(value) < 4 then 'none' when median(abs(value - 60)) <= 40 then 'hit' when median(abs(value - 60)) <= 75 then 'near' else 'miss' end as verdict, case when count(value) >= 4 then median(value - 60) end as dev from events group by all)
  select user_id, count(*) as targets, count(*) filter (verdict = 'hit') as hits, floor(100.0 * count(*) filter (verdict = 'hit') / count(*) + 0.5)::int as percent, round(median(abs(dev)), 6) as typical, round(median(dev), 6) as lean, count(*) filter (verdict = 'none') as silent, round(110 * pow(2, median(dev) / 1200), 6) as suggested_hz from t group by 1""")
def practice_report(spark, sf_dir):
    """Each user's report of judged targets."""
    dev = F.col("value") - 60
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(library.judge(dev).alias("verdict"), F.when(F.count("value") >= 4, F.median(dev)).alias("dev"))
    r = audit.practice_report(t, "user_id", 110.0)
    return r.select("user_id", "targets", "hits", "percent", F.round("typical", 6).alias("typical"), F.round("lean", 6).alias("lean"), "silent", F.round("suggested_hz", 6).alias("suggested_hz"))


_GLYPHS = "g as (select l_suppkey as page, (l_orderkey * 10 + l_linenumber) * 100 + l_partkey % 100 as id, (l_extendedprice / 100)::double as x, l_quantity::double as y, 4.0 as w, 1.0 + l_partkey % 3 as size, l_linenumber % 4 = 0 as mark from lineitem)"


@query(f"""with {_GLYPHS}, j as (select m.page, m.id, b.id as base, abs(b.x + b.w / 2 - m.x) as dx, b.size as bs from g m join g b on b.page = m.page and not b.mark and abs(b.y - m.y) <= m.size * 1.4 where m.mark),
  n as (select page, id, min(struct_pack(dx := dx, base := base, bs := bs)) as m from j group by 1, 2) select g.page, g.id, case when m.dx < m.bs * 1.6 then m.base end as base from g left join n using (page, id) where g.mark""")
def attached_marks(spark, sf_dir):
    """Marks and the glyphs that they belong to."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_partkey") % 100).alias("id"), (F.col("l_extendedprice") / 100).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"), F.lit(4.0).alias("w"), (F.col("l_partkey") % 3 + 1.0).alias("size"), (F.col("l_linenumber") % 4 == 0).alias("mark"))
    return audit.attach_marks(g.filter("mark").drop("mark", "w"), g.filter("not mark").drop("mark"), "page").select("page", "id", "base")


@query("""with b as (select distinct l_suppkey as page, floor(l_quantity / 10)::int as band, floor(l_quantity / 10) * 10.0 + 2 as low, floor(l_quantity / 10) * 10.0 + 5 as high from lineitem where l_quantity::int % 10 < 3 and floor(l_quantity / 10)::int % 2 = 0),
  p as (select l_suppkey as page, l_orderkey, l_linenumber, l_partkey, l_quantity + 0.5 as y from lineitem), j as (select p.*, b.band, greatest(0.0, b.low - y, y - b.high) as d from p join b using (page)),
  n as (select page, l_orderkey, l_linenumber, l_partkey, y, min(struct_pack(d := d, band := band)) as m from j where d < 12 group by all) select p.page, p.l_orderkey, p.l_linenumber, p.l_partkey, m.band from p left join n using (page, l_orderkey, l_linenumber, l_partkey, y)""")
def nearest_row_band(spark, sf_dir):
    """Rows of glyphs that stray ones belong to."""
    li = table(spark, sf_dir, "lineitem")
    ten = F.floor(F.col("l_quantity") / 10)
    b = li.filter("cast(l_quantity as int) % 10 < 3 and cast(floor(l_quantity / 10) as int) % 2 = 0").select(F.col("l_suppkey").alias("page"), ten.cast("int").alias("band"), (ten * 10.0 + 2).cast("double").alias("low"), (ten * 10.0 + 5).cast("double").alias("high")).distinct()
    p = li.select(F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + 0.5).cast("double").alias("y"))
    return audit.nearest_band(p, b, "page").select("page", "l_orderkey", "l_linenumber", "l_partkey", "band")


_LYRICS = f"""{_NUMBERED}, t as (select l_orderkey, n, substr('SRGM', (l_partkey % 4)::int + 1, 1) as w, case when l_partkey % 9 = 0 then 'X' else substr('SRGM', (l_partkey % 4)::int + 1, 1) end as sv, 'y' || l_suppkey as syl from u),
  want as (select l_orderkey, list(w order by n) as letters from t group by 1), lines as (select l_orderkey, line, list(sv order by n) as svaras, case when line % 3 < 2 then list(syl order by n) end as sahitya from (select *, ((n - 1) // 2)::int as line from t) group by 1, 2)"""


@query(f"""with {_LYRICS}, o as (select *, coalesce(sum(len(svaras)) over (partition by l_orderkey order by line rows between unbounded preceding and 1 preceding), 0)::int as spot from lines join want using (l_orderkey)),
  a as (select *, letters[spot + 1:spot + len(svaras)] as own from o), g as (select *, len(list_filter(range(1, len(svaras) + 1), lambda i: contains(svaras[i], own[i]))) as agree from a),
  e as (select l_orderkey, spot, sahitya, unnest(range(len(sahitya))) as k from g where sahitya is not null and agree >= 0.8 * len(own)) select l_orderkey, (spot + k)::int as pos, sahitya[k + 1] as syllable from e""")
def lyrics_by_position(spark, sf_dir):
    """Syllables at the places that they lie on, of lines that agree with the notation."""
    w = F.substr(F.lit("SRGM"), (F.col("l_partkey") % 4).cast("int") + 1, F.lit(1))
    t = numbered(spark, sf_dir).select("l_orderkey", "n", w.alias("w"), F.when(F.col("l_partkey") % 9 == 0, "X").otherwise(w).alias("sv"), F.concat(F.lit("y"), F.col("l_suppkey").cast("string")).alias("syl"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    want = t.groupBy("l_orderkey").agg(ordered("w").alias("letters"))
    lines = t.groupBy("l_orderkey", F.floor((F.col("n") - 1) / 2).cast("int").alias("line")).agg(ordered("sv").alias("svaras"), ordered("syl").alias("s")).withColumn("sahitya", F.when(F.col("line") % 3 < 2, F.col("s"))).drop("s")
    return audit.lyrics_by_position(lines, want, "l_orderkey", "line")


@query(f"""with {_NUMBERED}, t as (select l_orderkey, list(case when l_partkey % 3 = 0 then ',' else 'S' end order by n) as l from u group by 1)
  select l_orderkey, array_to_string(list_transform(range(1, len(l) + 1), lambda k: greatest(0, len(list_filter(l[:k], lambda x: x <> ',')) - 1)), ' ') as owners from t""")
def place_owners(spark, sf_dir):
    """Which svara sounds at each place."""
    t = numbered(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("l_partkey") % 3 == 0, ",").otherwise("S").alias("x")))), lambda s: s["x"]).alias("l"))
    return t.select("l_orderkey", F.array_join(audit.owners(F.col("l")).cast("array<string>"), " ").alias("owners"))


_M, _N = (2.0, 0.5, -1.0, 3.0, 10.0, 20.0), (0.5, 0.0, 0.25, 2.0, -1.0, 4.0)
_P = audit.product(_M, _N)


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * (2.0 * l_quantity - l_discount + 10) + 0.25 * (0.5 * l_quantity + 3 * l_discount + 20) - 1, 6) as x, round(2.0 * (0.5 * l_quantity + 3 * l_discount + 20) + 4, 6) as y from lineitem")
def affine_points(spark, sf_dir):
    """Points moved by the product of two matrices."""
    p = audit.affine(_P, F.col("l_quantity"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query(f"select user_id, event_id, round({_list(music.JUST)}[event_id % 12 + 1]::double + 1200 * (event_id % 3), 6) as cents from events")
def just_places(spark, sf_dir):
    """Cents of places in just intonation."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(music.position_cents(F.col("event_id") % 12, "ji") + 1200 * (F.col("event_id") % 3), 6).alias("cents"))


# Kernels.


@query("""with recursive c as (select n_nationkey as clip_id, list_transform(range(40), lambda k: sin(k * (n_nationkey + 1) / 9.0) + (k % 4) / 4.0) as x from nation), p as (select clip_id, x, unnest(range((40 / 2.5)::int)) as k from c)
  select clip_id, k::int as k, round(case when k * 2.5 >= 39 then x[40] else x[floor(k * 2.5)::int + 1] + (x[floor(k * 2.5)::int + 2] - x[floor(k * 2.5)::int + 1]) * (k * 2.5 - floor(k * 2.5)) end, 6) as value from p""")
def resampled(spark, sf_dir):
    """Two channels mixed down and resampled from 40 to 16 kHz."""
    x = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.sin(k * (F.col("n_nationkey") + 1) / 9.0) + (k % 4) / 4.0)
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("clip_id"), F.lit(40000).alias("sr"), F.array(F.transform(x, lambda v: v + 1), F.transform(x, lambda v: v - 1)).alias("channels"))
    r = kernels.mixdown_resample(c, 16000)
    return r.select(F.col("clip_id").cast("int").alias("clip_id"), F.posexplode("pcm").alias("k", "value")).select("clip_id", "k", F.round("value", 6).alias("value"))


@query(f"""with {CONTOUR}, w as (select clip_id, i, cents, voiced, list(case when voiced then cents end) over (partition by clip_id order by i rows between 8 preceding and 8 following exclude current row) as l from contour),
  m as (select *, list_filter(l, lambda x: x is not null) as near from w), d as (select *, cents - list_median(near) as off, floor(abs(cents - list_median(near)) / 1200 + 0.5) as steps from m)
  select clip_id, i, round(case when voiced then case when len(near) >= 4 and steps between 1 and 2 and abs(abs(off) - 1200 * steps) < 260 then cents - sign(off) * 1200 * steps else cents end end, 6) as clean from d""")
def clean_slips(spark, sf_dir):
    """Octave slips taken out after the fact, on both sides."""
    return kernels.clean_slips(fr.contour(frames(spark, sf_dir), TONIC)).select("clip_id", "i", F.round("clean", 6).alias("clean"))


_RESOLVE = f"""{_NUMBERED}, pl as (select l_orderkey as id, n, (l_quantity % 12)::int as p, case when l_partkey % 5 = 0 then (l_partkey % 3 - 1)::int end as pin from u),
  va as (select id, 0::bigint as k from pl where n = 1 union all select id, -1 from pl where n = 1 union all select id, n from pl where pin is not null),
  ro as (select va.id, va.k, n, p, case when va.k = n or va.k = -1 then null else pin end as pin from va join pl using (id)),
  st(id, k, n, p, o, cost, path) as (select id, k, n, p, o, 0.25 * abs(o), [o] from ro, (select unnest([-1, 0, 1]) as o) where n = 1 and (pin is null or pin = o) union all
    (select id, k, n, p, o, (m.cost)::decimal(12, 2), list_append(m.path, o) from (select ro.id, ro.k, ro.n, ro.p, w.o, min(struct_pack(cost := (st.cost + 0.25 * abs(w.o) + abs(ro.p + 12 * w.o - st.p - 12 * st.o))::decimal(12, 2), q := st.o, path := st.path)) as m
      from st join ro on ro.id = st.id and ro.k = st.k and ro.n = st.n + 1, (select unnest([-1, 0, 1]) as o) w where ro.pin is null or ro.pin = w.o group by 1, 2, 3, 4, 5))),
  fin as (select st.id, st.k, min(struct_pack(cost := cost, o := o, path := path)).path as path from st join (select id, max(n) as n from pl group by 1) z on z.id = st.id and z.n = st.n group by 1, 2)"""


def _places(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("n", (F.col("l_quantity") % 12).cast("int").alias("p"), F.when(F.col("l_partkey") % 5 == 0, (F.col("l_partkey") % 3 - 1).cast("int")).alias("pin"))))
    rows = numbered(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(s.alias("s"))
    return rows.select("id", F.transform("s", lambda x: x["p"]).alias("places"), F.transform("s", lambda x: x["pin"]).alias("pins"))


@query(f"with recursive {_RESOLVE} select id, array_to_string(path, ' ') as octaves from fin where k = 0")
def octave_resolver(spark, sf_dir):
    """Octaves of written places, some marked."""
    return kernels.octave_resolver(_places(spark, sf_dir)).select("id", F.array_join(F.col("octaves").cast("array<string>"), " ").alias("octaves"))


@query(f"""with recursive {_RESOLVE}, t as (select id, path from fin where k = 0), h as (select fin.id, count(*) as marked, count(*) filter (fin.path[fin.k] <> t.path[fin.k]) as missed from fin join t using (id) where fin.k > 0 group by 1)
  select h.id, marked, missed, len(list_filter(range(1, len(t.path) + 1), lambda i: t.path[i] <> b.path[i]))::int as blind from h join t using (id) join fin b on b.id = h.id and b.k = -1""")
def verify_octaves(spark, sf_dir):
    """How many marks are found again when hidden one by one, and all at once."""
    return kernels.verify_octaves(_places(spark, sf_dir))


@query()
def stream_stabilised(spark, sf_dir):
    """The causal stabiliser over a stream of frames, one state a clip."""
    return practice.stream_stabilised(spark, sf_dir)
