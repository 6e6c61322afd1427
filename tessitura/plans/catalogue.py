"""The operators bound to the driver's tables, one query each, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import music, names
from tessitura.operators import frames as fr
from tessitura.operators import kernels, tune
from tessitura.operators import library as lib
from tessitura.operators.staging import dealt
from tessitura.streaming import practice

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TONIC = 55.0
#: The scale that the queries decode against: the parent scale 29, and its places as SQL.
NUMBER, PLACES, LABELS = music.melakarta_rows()[28]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def by_user(events: DataFrame) -> DataFrame:
    """Events dealt out by user: small parts, as the analysis holds many sorts of one at a time."""
    return dealt(events, "user_id", each=1 << 19)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pitch frames: a clip is a user's events in order."""
    e = by_user(table(spark, sf_dir, "events"))
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("clip_id"), i.cast("long").alias("i"), "event_id", "event_type", F.col("value").alias("f0"), ((F.col("event_id") % 100) / 100).alias("conf"), ((F.col("event_id") * 7919) % 1000 / 1000).alias("rms"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate and truth in Hz: the contour, and the same moved by up to 90 cents with a fifth silent."""
    gt = F.when((F.col("event_id") * 31) % 10 < 8, F.col("f0") * F.pow(F.lit(2.0), (F.col("event_id") % 7 - 3) * 30 / 1200.0)).otherwise(0.0)
    return fr.voicing_mask(frames(spark, sf_dir)).select("clip_id", "i", F.when(F.col("voiced"), F.col("f0")).otherwise(0.0).alias("est"), gt.alias("gt"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.notes(fr.contour(frames(spark, sf_dir), TONIC), PLACES, LABELS)


FRAMES = """frames as (select user_id as clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, event_id, event_type, value as f0,
    (event_id % 100)::double / 100 as conf, ((event_id * 7919) % 1000)::double / 1000 as rms from events)"""
CONTOUR = FRAMES + f""", contour as (select *, conf >= 0.5 and rms > max(rms) over (partition by clip_id) * 0.045 and f0 > 0 as voiced, case when f0 > 0 then 1200 * log2(f0 / {TONIC}) end as cents from frames)"""
PAIRS = CONTOUR + """, pairs as (select clip_id, i, case when voiced then f0 else 0.0 end as est,
    case when (event_id * 31) % 10 < 8 then f0 * pow(2, (event_id % 7 - 3) * 30 / 1200.0::double) else 0.0 end as gt from contour)"""
STATES = ", ".join(f"({n}, {o * 1200 + music.EQUAL[p]}.0::double, {p}, '{s}', {o})" for n, (o, p, s) in enumerate((o, p, s) for o in range(-3, 4) for p, s in zip(PLACES, LABELS)))
NEAREST = CONTOUR + f""", states(n, sc, pos, label, oct) as (values {STATES}),
  near as (select c.clip_id, c.i, min(struct_pack(d := abs(cents - sc), n := n)) as best from contour c, states where cents is not null group by all),
  placed as (select c.*, s.sc, s.pos, s.label, s.oct from contour c left join near using (clip_id, i) left join states s on s.n = near.best.n)"""
NOTES = NEAREST + f""", st as (select *, coalesce(case when voiced then sc end, 1e300) as state from placed),
  nw as (select *, coalesce((state <> lag(state) over (partition by clip_id order by i))::int, 1) as fresh from st),
  rn as (select *, sum(fresh) over (partition by clip_id order by i) as run from nw),
  kk as (select *, row_number() over (partition by clip_id, run order by i) as k, count(*) over (partition by clip_id, run) as m from rn where voiced),
  ag as (select clip_id, run, min(i) as first_i, count(*) as n, any_value(label) as label, any_value(pos) as pos, any_value(oct) as oct, any_value(sc) as cents, avg(cents) as mean_cents, stddev_pop(cents) as sd,
     median(cents) filter (k <= greatest(1, m // 4)) as head, median(cents) filter (k > m - greatest(1, m // 4)) as tail from kk group by clip_id, run),
  notes as (select clip_id, row_number() over (partition by clip_id order by first_i) - 1 as idx, first_i, n, first_i * {music.HOP_S}::double as start_s, (first_i + n) * {music.HOP_S}::double as end_s, n * {music.HOP_S}::double as dur, label, pos, oct, cents, mean_cents, sd,
     tail - head as slide, mean_cents - cents as deviation, greatest(0.0, least(1.0, 1 - sd / 160)) as conf from ag)"""


@query(f"with {CONTOUR} select clip_id, i, round(cents, 6) as cents from contour")
def cents_projection(spark, sf_dir):
    return fr.with_cents(frames(spark, sf_dir), TONIC).select("clip_id", "i", F.round("cents", 6).alias("cents"))


@query(f"with {FRAMES} select clip_id, i, conf >= 0.5 and rms > max(rms) over (partition by clip_id) * 0.045 as voiced from frames")
def voicing_mask(spark, sf_dir):
    return fr.voicing_mask(frames(spark, sf_dir)).select("clip_id", "i", "voiced")


@query(f"with {FRAMES} select clip_id, i, (i * 256 + 400.0::double) / 16000 as t_s from frames")
def frame_times(spark, sf_dir):
    return frames(spark, sf_dir).select("clip_id", "i", music.frame_time(F.col("i")).alias("t_s"))


@query("select o_orderkey, greatest(0, floor((o_totalprice - 800 - 228) / 256))::bigint as n_frames from orders")
def frame_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", music.frame_count(F.col("o_totalprice")).alias("n_frames"))


HIST = CONTOUR + """, hist as (select clip_id, (floor(((cents % 1200) + 1200) % 1200 / 5))::bigint % 240 as bin, sum(conf) as weight from contour where voiced group by all)"""
_K = music.kernel(12 / 5, 8)
_T = sum(w for _, w in _K)
SMOOTH = HIST + f""", ker(k, w) as (values {", ".join(f"({k}, {w / _T!r}::double)" for k, w in _K)}),
  smooth as (select clip_id, (bin + k + 240) % 240 as bin, sum(weight * w) as weight from hist, ker group by all)"""


@query(f"with {HIST} select clip_id, bin, round(weight, 6) as weight from hist")
def pitch_class_histogram(spark, sf_dir):
    return fr.histogram(fr.contour(frames(spark, sf_dir), TONIC)).select("clip_id", "bin", F.round("weight", 6).alias("weight"))


@query(f"with {SMOOTH} select clip_id, bin, round(weight, 6) as weight from smooth")
def histogram_smoothed(spark, sf_dir):
    return fr.smooth_histogram(fr.histogram(fr.contour(frames(spark, sf_dir), TONIC))).select("clip_id", "bin", F.round("weight", 6).alias("weight"))


@query(f"""with {SMOOTH}, shifts as (select unnest(range(-150, 151, 5)) as shift), places(pc) as (values {", ".join(f"({p * 100})" for p in PLACES)}), ks as (select unnest(range(-6, 7)) as k),
  sc as (select clip_id, shift, sum(weight * exp(-0.5 * pow(k * 5 / 22.0::double, 2))) as score from shifts, places, ks, smooth where bin = (((pc + shift) // 5 + k) % 240 + 240) % 240 group by all),
  rk as (select *, row_number() over (partition by clip_id order by round(score, 9) desc, shift) as r from sc)
  select clip_id, shift, round(score, 4) as score from rk where r = 1""")
def tonic_offset(spark, sf_dir):
    hist = fr.smooth_histogram(fr.histogram(fr.contour(frames(spark, sf_dir), TONIC)))
    return fr.tonic_offset(hist, PLACES).select("clip_id", F.col("shift").cast("long").alias("shift"), F.round("score", 4).alias("score"))


_SCALES = ", ".join(f"({m}, {p})" for m, ps, _ in music.melakarta_rows() for p in ps)


@query(f"""with {SMOOTH}, f as (select clip_id, (floor(bin * 5 / 100.0 + 0.5 - 1e-9))::int % 12 as pos, sum(weight) as w from smooth group by all), sh as (select clip_id, pos, w / sum(w) over (partition by clip_id) as share from f),
  scales(mela, pos) as (values {_SCALES}), nm as (select clip_id, sqrt(sum(share * share)) as norm from sh group by 1),
  sc as (select clip_id, mela, round(sum(share) / (any_value(norm) * sqrt(7.0)), 9) as score from sh join scales using (pos) join nm using (clip_id) group by all),
  rk as (select *, row_number() over (partition by clip_id order by score desc, mela) as rank from sc) select clip_id, mela, round(score, 6) as score, rank from rk where rank <= 5""")
def fold12_cosine_topk(spark, sf_dir):
    hist = fr.smooth_histogram(fr.histogram(fr.contour(frames(spark, sf_dir), TONIC)))
    return fr.scale_matches(fr.fold12(hist), music.melakartas(spark)).select("clip_id", "mela", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {CONTOUR} select clip_id, i, case when voiced then round(median(case when voiced then cents end) over (partition by clip_id order by i rows between 1 preceding and 1 following), 6) end as smooth from contour")
def median_smooth(spark, sf_dir):
    return fr.median_smooth(fr.contour(frames(spark, sf_dir), TONIC)).select("clip_id", "i", F.round("smooth", 6).alias("smooth"))


@query(f"""with {CONTOUR}, ab as (select *, last_value(case when voiced then i end ignore nulls) over (partition by clip_id order by i rows between unbounded preceding and 1 preceding) as ia,
   last_value(case when voiced then cents end ignore nulls) over (partition by clip_id order by i rows between unbounded preceding and 1 preceding) as ca,
   first_value(case when voiced then i end ignore nulls) over (partition by clip_id order by i rows between 1 following and unbounded following) as ib,
   first_value(case when voiced then cents end ignore nulls) over (partition by clip_id order by i rows between 1 following and unbounded following) as cb from contour)
  select clip_id, i, round(case when voiced then cents when ib - ia - 1 <= 6 then ca + (cb - ca) * (i - ia) / (ib - ia) end, 6) as filled, voiced or coalesce(ib - ia - 1 <= 6, false) as voiced from ab""")
def gap_fill(spark, sf_dir):
    return fr.gap_fill(fr.contour(frames(spark, sf_dir), TONIC)).select("clip_id", "i", F.round("filled", 6).alias("filled"), F.col("voiced_filled").alias("voiced"))


@query(f"""with {CONTOUR}, w as (select *, first_value(case when voiced then i end ignore nulls) over a as ia, first_value(case when voiced then cents end ignore nulls) over a as ca,
   last_value(case when voiced then i end ignore nulls) over b as ib, last_value(case when voiced then cents end ignore nulls) over b as cb from contour
   window a as (partition by clip_id order by i rows between 5 preceding and current row), b as (partition by clip_id order by i rows between current row and 5 following))
  select clip_id, i, round(case when ib > ia then (cb - ca) / (ib - ia) end, 6) as slope from w""")
def local_slope(spark, sf_dir):
    return fr.local_slope(fr.contour(frames(spark, sf_dir), TONIC)).select("clip_id", "i", F.round("slope", 6).alias("slope"))


_NOTE = ["clip_id", "idx", "first_i", "n", "label", "pos", "oct"]


@query(f"with {NOTES} select {', '.join(_NOTE)}, round(mean_cents, 6) as mean_cents, round(sd, 5) as sd, round(slide, 6) as slide, round(deviation, 6) as deviation, round(conf, 6) as conf from notes")
def run_length_notes(spark, sf_dir):
    return decoded(spark, sf_dir).select(*_NOTE, F.round("mean_cents", 6).alias("mean_cents"), F.round("sd", 5).alias("sd"), F.round("slide", 6).alias("slide"), F.round("deviation", 6).alias("deviation"), F.round("conf", 6).alias("conf"))


@query(f"with {NOTES} select clip_id, idx, label, case when abs(slide) > 90 and sd > 32 then (case when slide > 0 then 'slide-up' else 'slide-down' end) when sd > 48 then 'kampita' when sd > 22 then 'light' else 'plain' end as artic from notes")
def articulation(spark, sf_dir):
    return fr.articulation(decoded(spark, sf_dir)).select("clip_id", "idx", "label", "artic")


@query(f"""with {NOTES}, t as (select *, lag(cents) over o as ca, lag(dur) over o as da, lag(end_s) over o as ea, lead(cents) over o as cb, lead(dur) over o as db, lead(start_s) over o as sb from notes window o as (partition by clip_id order by idx))
  select clip_id, idx, label, coalesce(dur < 0.12 - 1e-9 and (cents - ca) * (cb - cents) > 0 and start_s - ea < 0.05 and sb - end_s < 0.05 and (da > 1.5 * dur or db > 1.5 * dur), false) as transit from t""")
def transit_flag(spark, sf_dir):
    return fr.transit(decoded(spark, sf_dir)).select("clip_id", "idx", "label", "transit")


@query(f"""with {FRAMES}, l as (select clip_id, i, i * 0.016::double as t from frames), r as (select clip_id, i * 0.016::double + 0.005 as t, f0 from frames where i % 2 = 0),
  st as (select clip_id, case when count(*) > 1 then (max(t) - min(t)) / (count(*) - 1) else 0.01 end as step from r group by 1),
  ca as (select l.clip_id, l.i, l.t, arg_min(r.f0, struct_pack(d := round(abs(r.t - l.t), 9), t := r.t)) as f0, min(abs(r.t - l.t)) as d from l join r using (clip_id) group by all)
  select clip_id, i, coalesce(case when d <= greatest(step, 0.005) then f0 end, 0.0) as gt from l left join ca using (clip_id, i) left join st using (clip_id)""")
def asof_nearest(spark, sf_dir):
    f = frames(spark, sf_dir)
    left = f.select("clip_id", "i", (F.col("i") * 0.016).alias("t"))
    right = f.filter("i % 2 = 0").select("clip_id", (F.col("i") * 0.016 + 0.005).alias("t"), F.col("f0").alias("gt"))
    return fr.asof_nearest(left, right, "clip_id", "t", "gt").select("clip_id", "i", "gt")


INTERVAL = NOTES + f""", sp as (select clip_id, idx, label, cents, floor(start_s / {music.HOP_S} + 0.5)::bigint as a, floor(end_s / {music.HOP_S} + 0.5)::bigint - 1 as b from notes)"""


@query(f"with {INTERVAL} select f.clip_id, f.i, arg_max(sp.label, sp.idx) as note_label from frames f left join sp on f.clip_id = sp.clip_id and f.i between sp.a and sp.b group by f.clip_id, f.i")
def interval_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    return fr.note_frames(decoded(spark, sf_dir), f.select("clip_id", "i")).select("clip_id", "i", "note_label")


@query(f"with {NEAREST} select clip_id, i, label, pos, oct from placed")
def nearest_svara(spark, sf_dir):
    d = fr.with_cents(frames(spark, sf_dir), TONIC).withColumn("s", music.nearest_position(F.col("cents"), PLACES, LABELS))
    return d.select("clip_id", "i", F.col("s.label").alias("label"), F.col("s.pos").alias("pos"), F.col("s.oct").alias("oct"))


@query(f"""with {INTERVAL}, e as (select f.clip_id, f.i, arg_max(sp.label, sp.idx) as l, arg_max(sp.cents, sp.idx) as c from frames f left join sp on f.clip_id = sp.clip_id and f.i between sp.a and sp.b group by f.clip_id, f.i),
  j as (select e.*, p.label as gl, p.sc as gc from e join placed p using (clip_id, i))
  select clip_id, count(*) as frames, round(count(l)::double / count(*), 6) as coverage, round(coalesce(count(*) filter (l = gl and c = gc)::double / nullif(count(l), 0), 0), 6) as svara_accuracy, round(coalesce(count(*) filter (l = gl)::double / nullif(count(l), 0), 0), 6) as class_accuracy from j group by 1""")
def svara_agreement(spark, sf_dir):
    truth = fr.with_cents(frames(spark, sf_dir), TONIC).withColumn("s", music.nearest_position(F.col("cents"), PLACES, LABELS)).select("clip_id", "i", F.col("s.label").alias("gl"), F.col("s.oct").alias("go"))
    j = fr.note_frames(decoded(spark, sf_dir), truth, value="oct")
    return fr.agreement(j).join(j.groupBy("clip_id").agg(F.count("*").alias("frames")), "clip_id").select("clip_id", "frames", *[F.round(c, 6).alias(c) for c in ("coverage", "svara_accuracy", "class_accuracy")])


_SCORES = ["voicing_recall", "false_alarm", "raw_pitch", "raw_chroma", "overall", "octave_errors"]


def _scores_sql(src: str, keys: str) -> str:
    fold = "case when ((d % 1200) + 1200) % 1200 > 600 then ((d % 1200) + 1200) % 1200 - 1200 else ((d % 1200) + 1200) % 1200 end"
    return f"""(select {keys}, count(*) as frames, coalesce(count(*) filter (gt > 0 and est > 0)::double / nullif(count(*) filter (gt > 0), 0), 0) as voicing_recall,
      coalesce(count(*) filter (not gt > 0 and est > 0)::double / nullif(count(*) filter (not gt > 0), 0), 0) as false_alarm, coalesce(count(*) filter (abs(d) <= 50)::double / nullif(count(*) filter (gt > 0), 0), 0) as raw_pitch,
      coalesce(count(*) filter (abs({fold}) <= 50)::double / nullif(count(*) filter (gt > 0), 0), 0) as raw_chroma, (count(*) filter (abs(d) <= 50) + count(*) filter (not gt > 0 and not est > 0))::double / count(*) as overall,
      coalesce((count(*) filter (abs({fold}) <= 50) - count(*) filter (abs(d) <= 50))::double / nullif(count(*) filter (gt > 0), 0), 0) as octave_errors
      from (select *, case when est > 0 and gt > 0 then 1200 * log2(est / gt) end as d from {src}) group by {keys})"""


@query(f"with {PAIRS} select clip_id, frames, {', '.join(f'round({c}, 6) as {c}' for c in _SCORES)} from {_scores_sql('pairs', 'clip_id')}")
def melody_scores(spark, sf_dir):
    return fr.melody_scores(scored_pairs(spark, sf_dir), ["clip_id"]).select("clip_id", "frames", *[F.round(c, 6).alias(c) for c in _SCORES])


@query(f"""with {PAIRS}, lg as (select g.clip_id, g.i, l.lag, e.est, g.gt from pairs g, (select unnest(range(-3, 4)) as lag) l, pairs e where e.clip_id = g.clip_id and e.i = g.i + l.lag),
  s as (select *, row_number() over (partition by clip_id order by raw_pitch desc, lag) as r from {_scores_sql('lg', 'clip_id, lag')}) select clip_id, lag, frames, round(raw_pitch, 6) as raw_pitch, round(overall, 6) as overall from s where r = 1""")
def best_lag(spark, sf_dir):
    return fr.best_lag(scored_pairs(spark, sf_dir)).select("clip_id", F.col("lag").cast("long").alias("lag"), "frames", F.round("raw_pitch", 6).alias("raw_pitch"), F.round("overall", 6).alias("overall"))


_TOP = 55.0 * 2 ** (1900 / 1200)


@query(f"""with {PAIRS}, h as (select *, coalesce((sum((gt > {_TOP!r})::int) over (partition by clip_id))::double / nullif(sum((gt > 0)::int) over (partition by clip_id), 0), 0) as rate from pairs)
  select clip_id, i, round(rate, 6) as high_rate, round(case when rate > 0.1 and gt > {_TOP!r} then gt / pow(2, ceil(log2(gt / {_TOP!r}))) else gt end, 6) as folded from h""")
def fold_reference_octaves(spark, sf_dir):
    return fr.fold_reference(scored_pairs(spark, sf_dir), TONIC).select("clip_id", "i", F.round("high_rate", 6).alias("high_rate"), F.round("folded", 6).alias("folded"))


@query(f"""with {PAIRS}, m as (select clip_id, count(*) filter (gt > 0) as n, list_sort(list(gt) filter (gt > 0)) as a from pairs group by 1)
  select clip_id, n, round(a[n // 2 + 1] / 55.0, 6) as ratio, n <= 50 or a[n // 2 + 1] / 55.0 between 0.5 and 2.4 as ok from m""")
def record_gates(spark, sf_dir):
    g = scored_pairs(spark, sf_dir).groupBy("clip_id").agg(F.count_if(F.col("gt") > 0).alias("n"), F.collect_list(F.when(F.col("gt") > 0, F.col("gt"))).alias("a"))
    ratio = fr.upper_median(F.col("a")) / TONIC
    return g.select("clip_id", "n", F.round(ratio, 6).alias("ratio"), ((F.col("n") <= 50) | ratio.between(0.5, 2.4)).alias("ok"))


@query(f"with {PAIRS} select count(*) as records, {', '.join(f'round(coalesce(avg({c}), 0), 6) as {c}' for c in _SCORES)}, count(*) filter (raw_pitch >= 0.5) as good from {_scores_sql('pairs', 'clip_id')}")
def summary_macro(spark, sf_dir):
    s = fr.melody_scores(scored_pairs(spark, sf_dir), ["clip_id"])
    return s.agg(F.count("*").alias("records"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in _SCORES], F.count_if(F.col("raw_pitch") >= 0.5).alias("good"))


_FOLD = "regexp_replace(strip_accents(lower({})), '[^a-z]', '', 'g')"


@query(f"select doc_id, length({_FOLD.format('text')})::int as n, sha256({_FOLD.format('text')}) as digest from documents")
def name_fold(spark, sf_dir):
    key = names.fold(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(key).alias("n"), F.sha2(key, 256).alias("digest"))


def _rewritten(sql: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


def _squeezed(sql: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        sql = f"regexp_replace({sql}, '{c}+', '{c}', 'g')"
    return sql


@query(f"select p_partkey, {_squeezed('replace(' + _rewritten(_FOLD.format('p_name'), names.PHONETIC) + ', ' + chr(39) + 'm' + chr(39) + ', ' + chr(39) + 'n' + chr(39) + ')')} as phonetic, regexp_replace({_rewritten(_FOLD.format('p_name'), names.SCALE_NAMES)}, '(am|a|i|u|m)$', '') as scale from part")
def phonetic_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.phonetic_key(F.col("p_name")).alias("phonetic"), names.scale_key(F.col("p_name")).alias("scale"))


_KEYED = f"regexp_replace({_rewritten(_FOLD.format('{0}'), names.SCALE_NAMES)}, '(am|a|i|u|m)$', '')"


@query(f"""with n as (select name, min(k) as ord, {_KEYED.format('name')} as nkey from (select p_name as name, min(p_partkey) as k from part group by 1) group by name),
  q0 as (select p_partkey, left(p_name, 3) || substr(p_name, 4 + (p_partkey % 3)) as q from part), q as (select distinct q, {_KEYED.format('q')} as key from q0),
  c as (select q, ord, name, case when key = nkey then 0 else levenshtein(key, nkey) end as d, case when length(key) >= 8 then 2 else 1 end as budget, length(key) - length(nkey) as gap from q, n where key <> '' and nkey <> ''),
  m as (select q, min(struct_pack(d := d, ord := ord, name := name)) as m from c where d <= budget and abs(gap) <= budget group by q)
  select p_partkey, q, m.name as match, m.d::int as distance from q0 left join m using (q)""")
def fuzzy_rank(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dim = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    queries = part.select("p_partkey", F.concat(F.substr("p_name", F.lit(1), F.lit(3)), F.expr("substr(p_name, 4 + cast(p_partkey % 3 as int))")).alias("q"))
    return lib.fuzzy_rank(queries, dim).select("p_partkey", "q", "match", "distance")


@query("""with d as (select distinct p_name as name from part), k1 as (select lower(name) as key, min(name) as name from d group by 1 having count(distinct name) = 1), k2 as (select left(lower(name), 4) as key, min(name) as name from d group by 1 having count(distinct name) = 1),
  q as (select p_partkey, case p_partkey % 3 when 0 then upper(p_name) when 1 then left(p_name, 4) else p_type end as raw from part)
  select p_partkey, raw, coalesce(k1.name, k2.name) as match, case when k1.name is not null then 1 when k2.name is not null then 2 end as tier from q left join k1 on k1.key = lower(raw) left join k2 on k2.key = left(lower(raw), 4)""")
def tiered_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dim = part.select("p_name").distinct()
    exact = lib.unambiguous_keys(dim, "p_name", F.lower("p_name")).select("key", F.col("name").alias("n1"))
    loose = lib.unambiguous_keys(dim, "p_name", F.substr(F.lower("p_name"), F.lit(1), F.lit(4))).select(F.col("key").alias("key2"), F.col("name").alias("n2"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.substr("p_name", F.lit(1), F.lit(4))).otherwise(F.col("p_type"))
    q = part.select("p_partkey", raw.alias("raw")).withColumn("key", F.lower("raw")).withColumn("key2", F.substr(F.lower("raw"), F.lit(1), F.lit(4)))
    return q.join(exact, "key", "left").join(loose, "key2", "left").select("p_partkey", "raw", F.coalesce("n1", "n2").alias("match"), F.when(F.col("n1").isNotNull(), 1).when(F.col("n2").isNotNull(), 2).alias("tier"))


@query("""with old as (select c_custkey as k, c_acctbal as v, c_mktsegment as s from customer where c_custkey % 3 <> 0), new as (select c_custkey as k, case when c_custkey % 4 = 0 then null else c_acctbal + 1 end as v from customer where c_custkey % 2 = 0)
  select coalesce(old.k, new.k) as k, round(coalesce(new.v, old.v), 2) as v, s from old full join new on old.k = new.k""")
def full_outer_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("v"))
    return lib.upsert(old, new, "k").select("k", F.round("v", 2).alias("v"), "s")


@query("""with a as (select l_orderkey as k, list_sort(list(distinct l_linenumber)) as s from lineitem where l_returnflag <> 'R' group by 1), b as (select l_orderkey as k, list_sort(list(distinct l_linenumber)) as s from lineitem where l_linestatus = 'O' group by 1)
  select k, case when b.s is null then 'unmatched' when a.s = b.s then 'agree' else 'conflict' end as verdict, len(list_filter(a.s, lambda x: not list_contains(coalesce(b.s, []), x)))::int as only_a,
    len(list_filter(coalesce(b.s, []), lambda x: not list_contains(a.s, x)))::int as only_b, len(list_distinct(list_concat(a.s, coalesce(b.s, []))))::int as united from a left join b using (k)""")
def crosscheck_partition(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sets = lambda d, n: d.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linenumber")).alias(n))
    j = sets(li.filter("l_returnflag <> 'R'"), "a").join(sets(li.filter("l_linestatus = 'O'"), "b"), "k", "left")
    b = F.coalesce("b", F.array().cast("array<int>"))
    return j.select("k", F.when(F.col("b").isNull(), "unmatched").when(F.col("a") == F.col("b"), "agree").otherwise("conflict").alias("verdict"), F.size(F.array_except("a", b)).alias("only_a"), F.size(F.array_except(b, "a")).alias("only_b"), F.size(F.array_union("a", b)).alias("united"))


@query(f"with {FRAMES} select clip_id, i, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by clip_id order by i rows between unbounded preceding and current row) as carried from frames")
def carry_forward_context(spark, sf_dir):
    return lib.carry_forward(frames(spark, sf_dir), F.when(F.col("event_type") == "signup", F.col("event_id")), "clip_id", "i").select("clip_id", "i", "carried")


@query("""with g as (select l_suppkey, l_orderkey, l_linenumber, l_extendedprice as y, coalesce((l_extendedprice - lag(l_extendedprice) over o > 500)::int, 1) as fresh from lineitem window o as (partition by l_suppkey order by l_extendedprice, l_orderkey, l_linenumber, l_partkey))
  select l_suppkey, count(*) filter (fresh = 1) as clusters, count(*) as n from g group by 1""")
def chain_cluster(spark, sf_dir):
    d = lib.chain_cluster(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], "l_extendedprice", 500.0)
    return d.groupBy("l_suppkey").agg(F.max("cluster").alias("clusters"), F.count("*").alias("n"))


@query("""select a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, count(b.l_orderkey) as depth from lineitem a left join lineitem b on a.l_orderkey = b.l_orderkey and b.l_quantity < a.l_quantity and b.l_quantity >= a.l_quantity - 10 group by all""")
def band_join_depth(spark, sf_dir):
    li = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity").rangeBetween(-10, -1)
    d = li.withColumn("depth", F.count("*").over(w))
    return d.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.sum("depth").alias("depth"))


@query("select p_partkey, p_name, p_size from (select *, row_number() over (partition by lower(p_name) order by (p_size < 10) desc, p_partkey) as r from part) where r = 1")
def dedupe_prefer(spark, sf_dir):
    return lib.dedupe_prefer(table(spark, sf_dir, "part"), F.lower("p_name"), [F.desc(F.col("p_size") < 10), F.col("p_partkey")]).select("p_partkey", "p_name", "p_size")


@query("select c_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as latest, count(o_orderkey) as versions from customer left join orders on c_custkey = o_custkey group by 1")
def latest_version(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"), F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(v, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("m.o_orderkey").alias("latest"), F.coalesce("n", F.lit(0)).cast("long").alias("versions"))


@query("select p_partkey, p_name, p_brand from part where p_type = 'ECONOMY' and (p_name ilike '%ring%' or p_brand ilike '%#1%') order by p_size, p_name, p_partkey limit 50")
def browse_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter((F.col("p_type") == "ECONOMY") & (F.col("p_name").ilike("%ring%") | F.col("p_brand").ilike("%#1%")))
    return p.orderBy("p_size", "p_name", "p_partkey").limit(50).select("p_partkey", "p_name", "p_brand")


@query("select p_partkey, p_name from part a where p_partkey % 2 = 1 and not exists (select 1 from part b where b.p_partkey % 2 = 0 and lower(b.p_name) = lower(a.p_name) and b.p_brand = a.p_brand)")
def duplicate_guard(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("key", F.lower("p_name"))
    return p.filter("p_partkey % 2 = 1").join(p.filter("p_partkey % 2 = 0").select("key", "p_brand"), ["key", "p_brand"], "left_anti").select("p_partkey", "p_name")


@query("""with g as (select distinct k, substr(s, i, 3) as t from (select p_partkey as k, p_name as s, unnest(range(1, length(p_name) - 1)) as i from part) where length(s) >= 3), q as (select distinct substr(s, i, 3) as t from (select 'blue ring' as s, unnest(range(1, 8)) as i)),
  m as (select k, count(*)::double / 7 as similarity from g join q using (t) group by k) select k as p_partkey, round(similarity, 6) as similarity from m order by similarity desc, k limit 20""")
def trigram_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(lib.trigrams(F.col("p_name"))).alias("t"))
    wanted = [("blue ring"[i : i + 3],) for i in range(7)]
    m = p.join(F.broadcast(spark.createDataFrame(wanted, "t string")), "t").groupBy("p_partkey").agg(F.round(F.count("*") / 7, 6).alias("similarity"))
    return m.orderBy(F.desc("similarity"), "p_partkey").limit(20)


_TALAS = ", ".join(f"('{t}', '{a}', '{j}', {b})" for t, a in music.TALAS.items() for j, b in music.JATHIS.items())
_SIZE = "case substr(angas, {0}, 1) when 'L' then beats when 'D' then 2 else 1 end"


@query(f"with t(tala, angas, jathi, beats) as (values {_TALAS}) select tala, jathi, (select sum(case a when 'L' then beats when 'D' then 2 else 1 end) from (select unnest(string_split(angas, '')) as a))::int as cycle, jathi || ' ' || tala as label from t")
def tala_35(spark, sf_dir):
    return music.talas(spark).select("tala", "jathi", "cycle", F.concat_ws(" ", "jathi", "tala").alias("label"))


@query(f"""with t(tala, angas, jathi, beats) as (values {_TALAS}), u as (select *, unnest(range(1, length(angas) + 1)) as k from t), v as (select *, {_SIZE.format('k')} as size from u)
  select tala, jathi, k::int as anga, (sum(size) over (partition by tala, jathi order by k))::int as boundary from v""")
def anga_boundaries(spark, sf_dir):
    b = lib.anga_boundaries(F.col("angas"), F.col("beats"))
    return music.talas(spark).select("tala", "jathi", F.posexplode(b).alias("k", "boundary")).select("tala", "jathi", (F.col("k") + 1).alias("anga"), "boundary")


@query("""with u as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, (l_quantity % 3 + 1)::int as beats from lineitem),
  a as (select *, coalesce(sum(beats) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding), 0) as place from u), z as (select *, place - max(case when n = 2 then place end) over (partition by l_orderkey) as f from a),
  l as (select *, floor(f / 8.0) as c, floor(f / 8.0) * 3 + case when (f % 8 + 8) % 8 >= 6 then 2 when (f % 8 + 8) % 8 >= 4 then 1 else 0 end as a3 from z), p as (select *, lag(c) over o as pc, lag(a3) over o as pa from l window o as (partition by l_orderkey order by n))
  select l_orderkey, n::int as n, case when f is null then null when pc is null then (case when (f % 8 + 8) % 8 = 0 then 'avartana' when (f % 8 + 8) % 8 in (4, 6) then 'anga' end) when c <> pc then 'avartana' when a3 <> pa then 'anga' end as level from p""")
def bar_levels(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    u = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), (F.col("l_quantity") % 3 + 1).cast("int").alias("beats"), F.lit(2).alias("anchor"))
    return lib.bar_levels(u, "l_orderkey", "n", "beats", [4, 6, 8], "anchor").select("l_orderkey", "n", "level")


@query(f"with {FRAMES} select clip_id, i, (greatest(sum((event_type <> 'view')::int) over (partition by clip_id order by i), 1) - 1)::bigint // 8 as row_no from frames")
def wrap_rows(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("counts", F.col("event_type") != "view")
    return lib.wrap_rows(f, "clip_id", "i", "counts").select("clip_id", "i", F.col("row").cast("long").alias("row_no"))


@query("select event_id, (coalesce(case when event_id % 11 = 0 then event_id % 3 end, greatest(0, least(7, floor(value / 20 + 0.5) - 1))))::int as commas from events")
def comma_count(spark, sf_dir):
    manual = F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", lib.comma_count(F.col("value"), F.lit(20.0), manual).alias("commas"))


@query("""with s as (select l_orderkey, sum(l_quantity) as total, arg_min(l_quantity, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice)) as first from lineitem group by 1),
  k as (select *, unnest([8, 16, 32]) as c from s), b as (select *, total / c as x, (total + c - first) / c as y from k)
  select l_orderkey, bool_or((x >= 1 - 1e-6 and abs(x - floor(x + 0.5)) < 1e-6) or (first < c and y >= 1 - 1e-6 and abs(y - floor(y + 0.5)) < 1e-6)) as ok from b group by 1""")
def duration_ok(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.min_by("l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("first"))
    return s.select("l_orderkey", lib.duration_ok(F.col("total"), F.col("first"), F.lit(8)).alias("ok"))


@query("""with t as (select l_orderkey, l_linenumber, l_partkey, l_quantity as d, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and current row) * (60.0::double / 60 / 2) as e from lineitem)
  , x as (select l_orderkey, l_linenumber, l_partkey, e - d * 0.5 as s, e from t) select l_orderkey, round(min(s), 6) as first_s, round(max(e), 6) as end_s, count(*) as targets, count(*) filter (s <= 10 and 10 < e) as at_10 from x group by 1""")
def timed_targets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    t = lib.timed_targets(li, "l_orderkey", "n", "l_quantity", 2, 60.0)
    return t.groupBy("l_orderkey").agg(F.round(F.min("start_s"), 6).alias("first_s"), F.round(F.max("end_s"), 6).alias("end_s"), F.count("*").alias("targets"), F.count_if((F.col("start_s") <= 10) & (F.col("end_s") > 10)).alias("at_10"))


@query("select user_id, event_type, case when count(value) < 4 then 'none' when median(abs(value - 60)) <= 40 then 'hit' when median(abs(value - 60)) <= 75 then 'near' else 'miss' end as verdict from events group by all")
def judge(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(lib.judge(F.col("value") - 60).alias("verdict"))


@query("""with p as (select o_custkey as k, list(floor(o_totalprice / 50000)::int order by o_orderdate, o_orderkey) as a from orders group by 1)
  select k, len(a)::int as n, len(list_distinct(a))::int as n_distinct, len(list_filter(range(2, len(a) + 1), lambda i: a[i] < a[i - 1])) > 0 as vakra, case len(list_distinct(a)) when 7 then 'sampurna' when 6 then 'shadava' when 5 then 'audava' else 'other' end as kind from p""")
def vakra_classify(spark, sf_dir):
    a = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("int").alias("v")))), lambda s: s["v"])
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(a.alias("a"))
    turns = F.exists(F.zip_with("a", F.slice("a", 2, F.size("a")), lambda x, y: y < x), lambda x: F.coalesce(x, F.lit(False)))
    n = F.size(F.array_distinct("a"))
    return p.select("k", F.size("a").alias("n"), n.alias("n_distinct"), turns.alias("vakra"), F.when(n == 7, "sampurna").when(n == 6, "shadava").when(n == 5, "audava").otherwise("other").alias("kind"))


@query("select user_id, count(*) as n, list_sort(list(value))[floor(0.35 * count(*))::bigint + 1] as unit from events group by 1")
def unit_p35(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), fr.quantile_index(F.collect_list("value"), 0.35, 0.2).alias("unit"))


@query(f"with {FRAMES} select clip_id, i, case when i % 2 = 0 then 'tune' else 'test' end as part from frames")
def holdout_split(spark, sf_dir):
    return frames(spark, sf_dir).select("clip_id", "i", F.when(F.col("i") % 2 == 0, "tune").otherwise("test").alias("part"))


@query(f"""with {NOTES}, c as (select clip_id, label, oct, count(*) as n_notes, round(sum(dur), 6) as dur from notes group by all), r as (select *, row_number() over (partition by clip_id order by n_notes desc, label, oct) as rank from c) select * from r where rank <= 5""")
def top_notes(spark, sf_dir):
    """From frames to the commonest notes of each clip: contour, voicing, nearest place, runs, count."""
    n = fr.articulation(decoded(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("n_notes"), "label", "oct")).cast("long")
    counts = n.groupBy("clip_id", "label", "oct").agg(F.count("*").alias("n_notes"), F.round(F.sum("dur"), 6).alias("dur"))
    return counts.withColumn("rank", rank).filter("rank <= 5")


# Kernels, tuning, loading and streams.


@query("select n_nationkey, n_nationkey as semitone, 15::bigint as frames from nation")
def yin_track(spark, sf_dir):
    """A tone of 5,000 samples for each nation, one semitone apart, tracked."""
    rate = 16000
    hz = 110 * F.pow(F.lit(2.0), F.col("n_nationkey") / 12)
    pcm = F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda k: F.sin(2 * 3.141592653589793 * hz * k / rate) + 0.5 * F.sin(4 * 3.141592653589793 * hz * k / rate))
    clips = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("clip_id"), F.lit(rate).alias("sr"), pcm.alias("pcm"))
    f = kernels.yin_track(clips).groupBy("clip_id").agg(F.median("f0").alias("f0"), F.count("*").alias("frames"))
    return f.select(F.col("clip_id").cast("int").alias("n_nationkey"), music.half_up(12 * F.log2(F.col("f0") / 110)).cast("int").alias("semitone"), "frames")


@query()
def viterbi_decode(spark, sf_dir):
    return kernels.viterbi_decode(fr.contour(frames(spark, sf_dir), TONIC), PLACES, LABELS)


@query()
def align_sequences(spark, sf_dir):
    f = frames(spark, sf_dir).groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda s: s["event_type"]).alias("a"))
    return kernels.align_sequences(f.select(F.col("clip_id").alias("id"), "a").join(f.select((F.col("clip_id") - 1).alias("id"), F.col("a").alias("b")), "id"))


@query()
def coordinate_descent(spark, sf_dir):
    """The voicing thresholds tuned on even frames by overall accuracy, and how the held-out half does."""
    f = frames(spark, sf_dir).join(scored_pairs(spark, sf_dir).select("clip_id", "i", "gt"), ["clip_id", "i"])
    return tune.coordinate_descent(f, {"min_conf": [0.1, 0.3, 0.5, 0.7], "silence": [0.0, 0.045, 0.1, 0.3]}, {"min_conf": 0.5, "silence": 0.045})


@query("""with e as (select *, max(ts) over () - interval 10 minute as mark from events), w as (select *, unnest(range(0, 4)) as k from e), s as (select time_bucket(interval 15 minute, ts) - k * interval 15 minute as start, event_type, value, mark from w)
  select start, event_type, count(*) as n, round(avg(value), 6) as mean from s where start + interval 1 hour <= date_trunc('millisecond', mark) group by all""")
def stream_hop(spark, sf_dir):
    return practice.stream_hop(spark, sf_dir)


@query("""with e as (select *, max(ts) over () - interval 10 minute as mark, coalesce((ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute)::int, 1) as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) as sess from e),
  g as (select min(ts) as start, max(ts) + interval 30 minute as "end", user_id, count(*) as n, any_value(mark) as mark from s group by user_id, sess) select start, "end", user_id, n from g where "end" <= date_trunc('millisecond', mark)""")
def stream_sessions(spark, sf_dir):
    return practice.stream_sessions(spark, sf_dir)


@query("""with t as (select p_partkey, string_split(p_name, ' ')[1] as w from part) select p_partkey, upper(left(w, 1)) || repeat('''', (p_partkey % 3)::int) as token, (p_partkey % 3)::int as octave from t""")
def svara_tokens(spark, sf_dir):
    """Tokens written and read back."""
    made = F.concat(F.upper(F.substr(F.get(F.split("p_name", " "), F.lit(0)), F.lit(1), F.lit(1))), F.repeat(F.lit("'"), (F.col("p_partkey") % 3).cast("int")))
    d = table(spark, sf_dir, "part").select("p_partkey", made.alias("token"))
    return d.withColumn("octave", lib.token_octave(F.col("token")))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), t as (select doc_id, line, list_filter(string_split(line, ' '), lambda x: x <> '') as w from l)
  select doc_id, count(*) as lines, count(*) filter (len(w) >= 8 and len(list_filter(w, lambda x: length(x) <= 3))::double / len(w) >= 0.5) as short_lines from t group by 1""")
def token_lines(spark, sf_dir):
    """Lines of eight tokens or more of which half are short: the test for notation lines, with words for svaras."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return line.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(lib.token_line(F.col("line"), r"^.{1,3}$", 8, 0.5)).alias("short_lines"))


@query("""select l_orderkey, (case when bool_or(l_quantity % 4 = 0) then 4 when bool_or(l_quantity % 2 = 0) then 2 else 1 end * case when bool_or(l_quantity % 3 = 0) then 3 else 1 end)::int as grid from lineitem group by 1""")
def grid_factor(spark, sf_dir):
    """The least common multiple of the denominators of an order's durations."""
    q = F.col("l_quantity")
    den = F.when(q % 4 == 0, 4).when(q % 2 == 0, 2).otherwise(1)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lib.lcm_of(F.flatten(F.collect_list(F.array(den, F.when(q % 3 == 0, 3).otherwise(1))))).alias("grid"))


@query("""with new as (select p_partkey, p_name, p_brand from part where p_partkey % 2 = 0), old as (select min(p_partkey) as id, left(lower(p_name), 6) as k, p_brand from part where p_partkey % 2 = 1 group by 2, 3),
  linked as (select new.p_partkey, old.id from new left join old on left(lower(p_name), 6) = k and new.p_brand = old.p_brand), fresh as (select left(lower(n.p_name), 6) as k, n.p_brand, min(n.p_partkey) + 1000000 as id from new n join linked l using (p_partkey) where l.id is null group by 1, 2)
  select n.p_partkey, coalesce(l.id, f.id) as kriti_id, l.id is null as inserted from new n join linked l using (p_partkey) left join fresh f on f.k = left(lower(n.p_name), 6) and f.p_brand = n.p_brand""")
def staged_load(spark, sf_dir):
    """New pieces linked to old ones by title prefix and brand; the rest inserted, then linked."""
    p = table(spark, sf_dir, "part").withColumn("k", F.substr(F.lower("p_name"), F.lit(1), F.lit(6)))
    return lib.staged_load(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"), "p_partkey", ["k", "p_brand"])


_CELL = """label[1] || case when oct <= -1 then chr(803) when oct >= 1 then chr(775) else '' end || label[2:] || case when oct <= -2 then chr(803) when oct >= 2 then chr(775) else '' end
  || case artic when 'kampita' then '~' when 'slide-up' then '/' when 'slide-down' then chr(92) else '' end || repeat(' ,', greatest(0, least(7, floor(dur / unit + 0.5) - 1))::int)"""


@query(f"""with {NOTES}, ar as (select *, case when abs(slide) > 90 and sd > 32 then (case when slide > 0 then 'slide-up' else 'slide-down' end) when sd > 48 then 'kampita' when sd > 22 then 'light' else 'plain' end as artic, idx % 9 = 4 as transit from notes),
  un as (select clip_id, list_sort(list(dur))[floor(0.35 * count(*))::bigint + 1] as unit from ar group by 1), k as (select *, row_number() over (partition by clip_id order by idx) - 1 as k from ar join un using (clip_id) where not transit),
  l as (select clip_id, k // 8 as row_no, string_agg({_CELL}, '  ' order by k) as line from k group by 1, 2) select clip_id, string_agg(line, chr(10) order by row_no) as text from l group by 1""")
def notation_text(spark, sf_dir):
    """Clips as written notation, every ninth note hidden as one in transit."""
    n = fr.articulation(decoded(spark, sf_dir)).withColumn("transit", F.col("idx") % 9 == 4)
    return lib.notation_text(n)


@query("""with p as (select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) as links, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages) select page_id, title, len(links)::int as links from p""")
def page_scan(spark, sf_dir):
    """Title and list links of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1))).alias("links"))
