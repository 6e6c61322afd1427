"""More operators bound to the driver's tables: notation, lookups, loading."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import music
from tessitura.operators import frames as fr
from tessitura.operators import notation
from tessitura.operators.staging import dealt
from tessitura.plans.catalogue import CONTOUR, FRAMES, LABELS, NOTES, PLACES, TONIC, decoded, frames, query, table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_NUMBERED = f"u as (select *, row_number() over (partition by l_orderkey order by {_ORDER}) as n from lineitem)"


def numbered(spark, sf_dir):
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))))


@query(f"with {FRAMES}, h as (select *, (sum((event_type <> 'view')::int) over (partition by clip_id order by i))::bigint as n from frames) select clip_id, n, min(i) as start, count(*) as beats from h where n > 0 group by all")
def extension_hold(spark, sf_dir):
    return notation.extension_hold(frames(spark, sf_dir), "clip_id", "i", F.col("event_type") == "view", F.lit(1))


@query(f"with {_NUMBERED}, s as (select *, (sum((l_returnflag = 'R')::int) over (partition by l_orderkey order by n))::bigint as segment from u) select l_orderkey, segment, sum(case when l_returnflag = 'R' then 0.0 else l_quantity end)::double as beats from s group by all having beats > 0")
def bar_segments(spark, sf_dir):
    return notation.segments(numbered(spark, sf_dir), "l_orderkey", "n", F.col("l_returnflag") == "R", F.col("l_quantity"))


_CELLS = f"{_NUMBERED}, c as (select l_orderkey, (n - 1) // 3 as line, n as pos, case when l_returnflag = 'R' then 'bar' else 'note' end as kind from u)"


@query(f"""with {_CELLS}, t as (select *, coalesce(line <> lag(line) over w and kind <> 'bar' and lag(kind) over w <> 'bar', false) as turned from c window w as (partition by l_orderkey order by line, pos)),
  e as (select l_orderkey, line, pos, unnest(case when turned then ['bar', 'own'] else ['own'] end) as k, kind from t) select l_orderkey, row_number() over (partition by l_orderkey order by line, pos, k) as n, case when k = 'bar' then 'bar' else kind end as kind from e""")
def join_lines(spark, sf_dir):
    c = numbered(spark, sf_dir).select("l_orderkey", F.floor((F.col("n") - 1) / 3).alias("line"), F.col("n").alias("pos"), F.when(F.col("l_returnflag") == "R", "bar").otherwise("note").alias("kind"))
    return notation.join_lines(c, "l_orderkey", "line", "pos", "kind")


@query(f"with {FRAMES} select clip_id, i, (sum((event_type = 'signup')::int) over (partition by clip_id order by i))::bigint as line from frames")
def chunk_lines(spark, sf_dir):
    return notation.chunk_lines(frames(spark, sf_dir), "clip_id", "i", F.col("event_type") == "signup").select("clip_id", "i", "line")


@query(f"with {NOTES}, p as (select clip_id, i, i * 0.016::double + 0.004 as t from frames) select p.clip_id, p.i, notes.label from p left join notes on notes.clip_id = p.clip_id and p.t >= notes.start_s and p.t < notes.end_s")
def target_at(spark, sf_dir):
    points = frames(spark, sf_dir).select("clip_id", "i", (F.col("i") * 0.016 + 0.004).alias("t"))
    return notation.point_lookup(points, decoded(spark, sf_dir).select("clip_id", "start_s", "end_s", "label"), "clip_id", "t", "label").select("clip_id", "i", "label")


@query(f"""with {FRAMES}, l as (select clip_id, i, f0 as x from frames where i % 2 = 1), r as (select clip_id, f0 as x, min(event_id) as v from frames where i % 2 = 0 group by all),
  c as (select l.clip_id, l.i, arg_min(r.v, struct_pack(d := abs(r.x - l.x), x := r.x)) as v from l join r on l.clip_id = r.clip_id and abs(r.x - l.x) <= 2.5 group by all) select l.clip_id, l.i, c.v from l left join c using (clip_id, i)""")
def nearest_in_band(spark, sf_dir):
    f = frames(spark, sf_dir)
    left = f.filter("i % 2 = 1").select("clip_id", "i", F.col("f0").alias("x"))
    right = f.filter("i % 2 = 0").groupBy("clip_id", F.col("f0").alias("x")).agg(F.min("event_id").alias("v"))
    return notation.nearest_in_band(left, right, "clip_id", "x", "v", 2.5).select("clip_id", "i", "v")


@query("select p_partkey, coalesce(case when lower(p_name) like '%ring%' then 'ring' end, case when lower(p_name) like '%blue%' then 'blue' end, case when lower(p_name) like '%bolt%' then 'bolt' end, 'none') as language from part")
def language_of(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", notation.first_contained(F.col("p_name"), ["ring", "blue", "bolt"], "none").alias("language"))


@query(f"with {NOTES} select clip_id, round(avg(abs(deviation)), 6) as mean_deviation, round(avg(conf), 6) as mean_conf, count(*) as n from notes group by 1")
def quality_summary(spark, sf_dir):
    q = notation.quality_summary(decoded(spark, sf_dir), "clip_id")
    return q.select("clip_id", F.round("mean_deviation", 6).alias("mean_deviation"), F.round("mean_conf", 6).alias("mean_conf"), "n")


@query("select user_id, round(20 * log10(sqrt(avg(value * value)) / 32768), 6) as level from events group by 1")
def excerpt_level(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(notation.dbfs(F.col("value")), 6).alias("level"))


@query("select p_name as name, count(*) as n from part group by 1 order by n desc, name limit 40")
def unmatched_counts(spark, sf_dir):
    """A top-40 report of counts."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(40)


@query("select c.n_nationkey, c.n_name, p.n_name as parent from nation c left join nation p on p.n_nationkey = c.n_nationkey % 5")
def parent_update(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.withColumn("k", F.col("n_nationkey") % 5).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("parent")), "k", "left").select("n_nationkey", "n_name", "parent")


@query("select o_orderkey, lag(o_orderkey) over w as parent_version, row_number() over w::int as version from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def version_chain(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("parent_version"), F.row_number().over(w).alias("version"))


_RANGE = "r as (select clip_id, min(cents) filter (voiced) as low, max(cents) filter (voiced) as high from contour group by 1)"
_STATES = ", ".join(f"({o * 1200 + music.EQUAL[p]}.0::double, '{s}', {o})" for o in range(-3, 4) for p, s in zip(PLACES, LABELS))


@query(f"with {CONTOUR}, {_RANGE}, st(cents, label, oct) as (values {_STATES}) select clip_id, cents, label, oct from r, st where cents between coalesce(low, -1200) - 150 and coalesce(high, 1200) + 150")
def build_states(spark, sf_dir):
    """The scale's places within 150 cents of each clip's range."""
    r = fr.contour(frames(spark, sf_dir), TONIC).groupBy("clip_id").agg(F.min(F.when(F.col("voiced"), F.col("cents"))).alias("low"), F.max(F.when(F.col("voiced"), F.col("cents"))).alias("high"))
    states = F.array(*[F.struct(F.lit(float(o * 1200 + music.EQUAL[p])).alias("cents"), F.lit(s).alias("label"), F.lit(o).alias("oct")) for o in range(-3, 4) for p, s in zip(PLACES, LABELS)])
    inside = F.filter(states, lambda s: s["cents"].between(F.coalesce(F.col("low"), F.lit(-1200.0)) - 150, F.coalesce(F.col("high"), F.lit(1200.0)) + 150))
    return r.select("clip_id", F.explode(inside).alias("s")).select("clip_id", "s.cents", "s.label", "s.oct")


@query(f"with {CONTOUR} select clip_id, i, round(case when ((cents % 1200) + 1200) % 1200 > 600 then ((cents % 1200) + 1200) % 1200 - 1200 else ((cents % 1200) + 1200) % 1200 end, 6) as folded, round(((cents % 1200) + 1200) % 1200, 6) as pitch_class from contour")
def octave_fold(spark, sf_dir):
    d = fr.with_cents(frames(spark, sf_dir), TONIC)
    return d.select("clip_id", "i", F.round(music.fold_octave(F.col("cents")), 6).alias("folded"), F.round(music.pitch_class(F.col("cents")), 6).alias("pitch_class"))
