"""The whole analysis and its scores bound to the driver's tables: each user's events are a clip with a tonic and a scale of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import music
from tessitura.operators import analysis
from tessitura.operators import frames as fr
from tessitura.operators import kernels
from tessitura.plans.catalogue import FRAMES, by_user, frames, query, scored_pairs, table

#: Cents of the twelve places, the scales' places, and the tonic and scale of a clip, as SQL.
_TONIC = "55.0::double * (1 + (clip_id % 5) / 50.0::double)"
_SCALES = ", ".join(f"({m}, {ps}, {ls})" for m, ps, ls in music.melakarta_rows())


def scales(spark):
    """The 72 parent scales with lines: every other one leaves out its third and seventh label going up."""
    t = music.melakartas(spark)
    up = F.when(F.col("mela") % 2 == 0, F.filter("labels", lambda x, k: ~k.isin(2, 6))).otherwise(F.col("labels"))
    t = t.withColumn("name", F.concat(F.lit("scale "), F.translate(F.lpad(F.col("mela").cast("string"), 2, "0"), "0123456789", "bcdfgklnpr")))
    return t.withColumn("up", analysis.direction_labels(F.array_join(up, " "))).withColumn("down", analysis.direction_labels(F.array_join("labels", " ")))


def clips(spark, sf_dir):
    """(clip_id, tonic_hz, start_s, mela, name, positions, labels, up, down)."""
    # Dealt out as the frames are, so that joins with them deal nothing out anew.
    ids = by_user(table(spark, sf_dir, "events").select("user_id").distinct()).select(F.col("user_id").alias("clip_id")).withColumn("mela", (F.col("clip_id") % 72 + 1).cast("int"))
    d = ids.join(F.broadcast(scales(spark)), "mela")
    return d.withColumn("tonic_hz", F.lit(55.0) * (1 + F.col("clip_id") % 5 / F.lit(50.0))).withColumn("start_s", F.col("clip_id") % 3 / F.lit(2.0))


CLEAN = FRAMES + f""", raw as (select clip_id, i, conf, f0, conf >= 0.5 and rms > max(rms) over (partition by clip_id) * 0.045 and f0 > 0 as voiced, case when f0 > 0 then 1200 * log2(f0 / ({_TONIC})) end as cents from frames),
  a as (select clip_id, list(voiced order by i) as v, list(coalesce(cents, 0.0) order by i) as c, count(*) as n from raw group by 1),
  rep(clip_id, k, c) as (select clip_id, 0::bigint, c from a union all
    select clip_id, k + 1, list_concat(c[:j - 1], [case when v[j] and len(near) >= 4 and abs(c[j] - list_median(near) - 1200) < 260 then c[j] - 1200 when v[j] and len(near) >= 4 and abs(c[j] - list_median(near) + 1200) < 260 then c[j] + 1200 else c[j] end], c[j + 1:])
    from (select *, list_transform(list_filter(range(greatest(1, j - 8), least(n, j + 8) + 1), lambda x: x <> j and v[x]), lambda x: c[x]) as near from (select rep.clip_id, k, rep.c, v, n, k % n + 1 as j from rep join a using (clip_id) where k < 2 * n))),
  done as (select clip_id, c from rep join (select clip_id, n from a) using (clip_id) where k = 2 * n),
  fixed as (select raw.clip_id, i, conf, voiced, case when voiced then c[i + 1] else cents end as cents from raw join done using (clip_id)),
  med as (select *, case when voiced then median(case when voiced then cents end) over (partition by clip_id order by i rows between 1 preceding and 1 following) else cents end as s from fixed),
  ab as (select *, last_value(case when voiced then i end ignore nulls) over p as ia, last_value(case when voiced then s end ignore nulls) over p as ca, first_value(case when voiced then i end ignore nulls) over f as ib, first_value(case when voiced then s end ignore nulls) over f as cb
    from med window p as (partition by clip_id order by i rows between unbounded preceding and 1 preceding), f as (partition by clip_id order by i rows between 1 following and unbounded following)),
  clean as (select clip_id, i, conf, case when voiced then s when ib - ia - 1 <= 6 then ca + (cb - ca) * (i - ia) / (ib - ia) else s end as cents, voiced or coalesce(ib - ia - 1 <= 6, false) as voiced from ab)"""
_KERNEL = music.kernel(12 / 5, 8)
_MASS = sum(w for _, w in _KERNEL)
SMOOTHED = CLEAN + f""", h as (select clip_id, (floor(((cents % 1200) + 1200) % 1200 / 5))::bigint % 240 as bin, sum(conf) as weight from clean where voiced group by all),
  ker(k, w) as (values {", ".join(f"({k}, {w / _MASS!r}::double)" for k, w in _KERNEL)}), hist as (select clip_id, (bin + k + 240) % 240 as bin, sum(weight * w) as weight from h, ker group by all)"""
TONIC = SMOOTHED + f""", scales(mela, positions, labels) as (values {_SCALES}), own as (select clip_id, unnest(positions) as pos from (select distinct clip_id from frames) join scales on mela = clip_id % 72 + 1),
  sc as (select clip_id, shift, sum(weight * exp(-0.5 * pow(k * 5 / 22.0::double, 2))) as score from hist join own using (clip_id), (select unnest(range(-150, 151, 5)) as shift) s, (select unnest(range(-6, 7)) as k) q
    where bin = ((pos * 100 + shift) // 5 + k + 480) % 240 group by all),
  best as (select clip_id, shift from (select *, row_number() over (partition by clip_id order by round(score, 9) desc, shift) as r from sc) where r = 1),
  tonic as (select clip_id, coalesce(shift, 0)::int as shift, case when abs(shift) >= 12 then shift else 0 end::int as applied from (select distinct clip_id from frames) left join best using (clip_id))"""


@query(f"with recursive {CLEAN} select clip_id, i, round(cents, 6) as cents, voiced from clean")
def clean_contour(spark, sf_dir):
    return analysis.clean_contour(frames(spark, sf_dir), clips(spark, sf_dir)).select("clip_id", "i", F.round("cents", 6).alias("cents"), "voiced")


@query(f"with recursive {CLEAN} select clip_id, i, round(case when voiced then cents end, 6) as repaired from fixed")
def repair_octaves(spark, sf_dir):
    """Cents of voiced frames after octave repair, over each clip's own tonic."""
    d = frames(spark, sf_dir).join(clips(spark, sf_dir).select("clip_id", "tonic_hz"), "clip_id").withColumn("cents", music.cents(F.col("f0"), F.col("tonic_hz")))
    d = fr.voicing_mask(d).withColumn("voiced", F.col("voiced") & F.col("cents").isNotNull())
    return kernels.repair_octaves(d).withColumn("repaired", F.round("repaired", 6))


def _done(spark, sf_dir, **how):
    return analysis.finish_analysis(frames(spark, sf_dir), clips(spark, sf_dir), scales(spark), analysis.Config(**how))


@query(f"with recursive {TONIC} select clip_id, shift, applied from tonic")
def tonic_correction(spark, sf_dir):
    """Where each clip's scale fits best, and what is applied."""
    return _done(spark, sf_dir).tonic.select("clip_id", F.col("shift").cast("int").alias("shift"), F.col("applied").cast("int").alias("applied"))


@query(f"""with recursive {TONIC}, f as (select clip_id, (floor(bin * 5 / 100.0 + 0.5 - 1e-9))::int % 12 as pos, sum(weight) as w from hist group by all), sh as (select clip_id, pos, w / sum(w) over (partition by clip_id) as share from f),
  places as (select mela, unnest(positions) as pos from scales), nm as (select clip_id, sqrt(sum(share * share)) as norm from sh group by 1),
  c as (select clip_id, mela, round(sum(share) / (any_value(norm) * sqrt(7.0)), 9) as score from sh join places using (pos) join nm using (clip_id) group by all),
  r as (select *, row_number() over (partition by clip_id order by score desc, mela) as rank from c) select clip_id, mela, round(score, 6) as score, rank from r where rank <= 5""")
def scale_suggestions(spark, sf_dir):
    return _done(spark, sf_dir).suggestions.select("clip_id", "mela", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def finish_analysis(spark, sf_dir):
    """Notes of every clip by the whole analysis, the grammar of its scale on."""
    n = _done(spark, sf_dir, switch=1.5, sigma=80.0).notes
    return n.select("clip_id", "idx", "first_i", "n", "label", "pos", "oct", F.round("mean_cents", 6).alias("mean_cents"), F.round("deviation", 6).alias("deviation"), F.round("conf", 6).alias("conf"), "artic", "transit")


@query()
def analysis_quality(spark, sf_dir):
    q = _done(spark, sf_dir).quality
    return q.select("clip_id", "notes", *[F.round(c, 6).alias(c) for c in ("mean_deviation", "mean_conf", "voiced_ratio")])


def _reference(spark, sf_dir):
    """The truth of ``scored_pairs`` as a contour of its own times."""
    return scored_pairs(spark, sf_dir).select("clip_id", ((F.col("i") * music.HOP + 400) / F.lit(16000.0) + F.col("clip_id") % 3 / F.lit(2.0) + 0.002).alias("t_s"), F.col("gt").alias("hz"))


def _scores(spark, sf_dir):
    return analysis.score_records(frames(spark, sf_dir), _reference(spark, sf_dir), clips(spark, sf_dir), scales(spark), analysis.Config(switch=1.5, sigma=80.0), jitter=30.0)


_MARKED = f"""ref as (select clip_id, i, case when (event_id * 31) % 10 < 8 then f0 * pow(2, (event_id % 7 - 3) * 30 / 1200.0::double) else 0.0 end as gt from frames),
  cnt as (select clip_id, count(*) as frames from frames group by 1), used as (select clip_id, {_TONIC} as tonic from cnt where frames >= 50),
  g as (select clip_id, list_sort(list(gt) filter (gt > 0)) as a, count(*) filter (gt > 0) as n from ref join used using (clip_id) group by 1)"""


@query(f"""with {FRAMES}, {_MARKED}, q as (select clip_id, n, a[n // 2 + 1] / tonic as ratio from g join used using (clip_id)),
  o as (select clip_id, case when n > 50 then ratio end as ratio, n <= 50 or ratio between 0.5 and 2.4 as ok from q),
  h as (select clip_id, gt, tonic * {2 ** (1900 / 1200)!r}::double as top, ok from ref join used using (clip_id) join o using (clip_id)),
  w as (select clip_id, coalesce(count(*) filter (gt > top)::double / nullif(count(*) filter (gt > 0), 0), 0) as rate, count(*) filter (gt > top) as high, any_value(ok) as ok from h group by 1)
  select cnt.clip_id, frames, case when frames < 50 then 'segment too short' end as skipped, round(ratio, 6) as ratio, o.ok as octave_ok, round(rate, 6) as high_rate, case when w.ok is not null then (case when w.ok and rate > 0.1 then high else 0 end)::bigint end as folded_frames,
    case when w.ok is not null then 30.0::double end as true_offset
  from cnt left join o using (clip_id) left join w using (clip_id)""")
def record_gate_scores(spark, sf_dir):
    """Which records are scored: skipped, octave gate, folding, and the known error of the tonic."""
    g = analysis.record_gates(frames(spark, sf_dir), _reference(spark, sf_dir), clips(spark, sf_dir), jitter=30.0)
    return g.select("clip_id", "frames", "skipped", F.round("ratio", 6).alias("ratio"), "octave_ok", F.round("high_rate", 6).alias("high_rate"), "folded_frames", F.round("true_offset", 6).alias("true_offset"))


@query()
def score_records(spark, sf_dir):
    """All scores of every record, flat."""
    s = _scores(spark, sf_dir)
    flat = [F.round(f"{a}.{b}", 6).alias(f"{a}_{b}") for a in ("raw", "processed") for b in ("raw_pitch", "raw_chroma", "overall")]
    return s.select("clip_id", "frames", "skipped", *flat, "processed.lag", F.round("chroma", 6).alias("chroma"), "alignment_ok", "octave_ok", F.round("svara_accuracy", 6).alias("svara_accuracy"), F.round("coverage", 6).alias("coverage"), "scale_rank", F.round("tonic.residual", 6).alias("residual"), "notes")


@query()
def score_summary(spark, sf_dir):
    """The summary of all records, one row."""
    s = analysis.summarize(_scores(spark, sf_dir))
    return s.select([F.round(c, 6).alias(c) if t == "double" else F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in s.dtypes])
