"""Operators over frames (clip_id, i, ...): rows of a clip in order of i. A clip is one bounded recording."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.music import EQUAL, HOP_S, JUST, cents, fold_octave, half_up, kernel, nearest_position, pitch_class


def _clip() -> Window:
    return Window.partitionBy("clip_id")


def _order() -> Window:
    return _clip().orderBy("i")


def voicing_mask(frames: DataFrame, min_conf: float = 0.5, silence: float = 0.045) -> DataFrame:
    """voiced: confident enough and strictly louder than a share of the clip's loudest frame."""
    return frames.withColumn("voiced", (F.col("conf") >= min_conf) & (F.col("rms") > F.max("rms").over(_clip()) * silence))


def with_cents(frames: DataFrame, tonic: float = 55.0) -> DataFrame:
    return frames.withColumn("cents", cents(F.col("f0"), F.lit(tonic)))


def contour(frames: DataFrame, tonic: float = 55.0) -> DataFrame:
    """Cents and voicing; unvoiced and unpitched frames count as unvoiced."""
    return voicing_mask(with_cents(frames, tonic)).withColumn("voiced", F.col("voiced") & F.col("cents").isNotNull())


def median_smooth(df: DataFrame, w: int = 1) -> DataFrame:
    """smooth: median of the voiced cents within w frames; null where unvoiced."""
    near = F.array_sort(F.collect_list(F.when(F.col("voiced"), F.col("cents"))).over(_order().rowsBetween(-w, w)))
    n = F.size("__near")
    mid = lambda k: F.get("__near", k.cast("int"))
    middle = F.when(n % 2 == 1, mid((n - 1) / 2)).otherwise((mid(n / 2 - 1) + mid(n / 2)) / 2)
    return df.withColumn("__near", near).withColumn("smooth", F.when(F.col("voiced"), middle)).drop("__near")


def gap_fill(df: DataFrame, most: int = 6) -> DataFrame:
    """Unvoiced runs of ``most`` frames or fewer between voiced frames are interpolated: filled (cents) and voiced_filled. Beyond ``most`` rows no frame counts."""
    here = F.when(F.col("voiced"), F.struct("i", "cents"))
    d = df.withColumn("__a", F.last(here, True).over(_order().rowsBetween(Window.unboundedPreceding, -1))).withColumn("__b", F.first(here, True).over(_order().rowsBetween(1, most)))
    short = ~F.col("voiced") & (F.col("__b.i") - F.col("__a.i") - 1 <= most)
    line = F.col("__a.cents") + (F.col("__b.cents") - F.col("__a.cents")) * (F.col("i") - F.col("__a.i")) / (F.col("__b.i") - F.col("__a.i"))
    short = F.coalesce(short, F.lit(False))
    return d.withColumn("filled", F.when(F.col("voiced"), F.col("cents")).when(short, line)).withColumn("voiced_filled", F.col("voiced") | short).drop("__a", "__b")


def local_slope(df: DataFrame, w: int = 5) -> DataFrame:
    """slope: cents a frame between the outermost voiced frames within w, one on each side or the frame itself."""
    here = F.when(F.col("voiced"), F.struct("i", "cents"))
    d = df.withColumn("__a", F.first(here, True).over(_order().rowsBetween(-w, 0))).withColumn("__b", F.last(here, True).over(_order().rowsBetween(0, w)))
    return d.withColumn("slope", F.when(F.col("__b.i") > F.col("__a.i"), (F.col("__b.cents") - F.col("__a.cents")) / (F.col("__b.i") - F.col("__a.i")))).drop("__a", "__b")


def histogram(df: DataFrame, bin_cents: int = 5) -> DataFrame:
    """(clip_id, bin, weight): confidence of voiced frames by pitch class; only bins that have some."""
    return df.filter("voiced").groupBy("clip_id", (F.floor(pitch_class(F.col("cents")) / bin_cents) % (1200 // bin_cents)).alias("bin")).agg(F.sum("conf").alias("weight"))


def smooth_histogram(hist: DataFrame, bin_cents: int = 5, sigma_cents: float = 12.0) -> DataFrame:
    """Circular Gaussian smoothing, mass preserved; each bin is spread over its neighbours by a small, fixed kernel."""
    sigma, nb = sigma_cents / bin_cents, 1200 // bin_cents
    rows = kernel(sigma, -int(-sigma * 3 // 1))
    total = sum(w for _, w in rows)
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in rows]))
    return hist.select("clip_id", "bin", "weight", spread.alias("s")).groupBy("clip_id", F.pmod(F.col("bin") + F.col("s.k"), F.lit(nb)).alias("bin")).agg(F.sum(F.col("weight") * F.col("s.w")).alias("weight"))


def shift_table(spark: SparkSession, most: int = 150, bin_cents: int = 5, temperament: str = "et") -> DataFrame:
    """(bin, pos, shift, w): what a bin's weight adds to the score of a shift by each of the twelve places. A fixed table."""
    rows, nb = kernel(22 / bin_cents, 6), 1200 // bin_cents
    table: dict[tuple[int, int, int], float] = {}
    for p, at in enumerate(JUST if temperament == "ji" else EQUAL):
        for s in range(-most, most + 1, bin_cents):
            for k, w in rows:
                b = (math.floor((at + s) / bin_cents + 0.5) + k) % nb
                table[b, p, s] = table.get((b, p, s), 0.0) + w
    return spark.createDataFrame([(b, p, s, w) for (b, p, s), w in sorted(table.items())], "bin long, pos int, shift int, w double")


def tonic_offset(hist: DataFrame, positions: list[int], most: int = 150, bin_cents: int = 5) -> DataFrame:
    """(clip_id, shift, score): the shift at which the scale's places meet most weight; the lowest on ties; no row for clips without weight.

    Every bin adds to the few shifts that bring a place near it, so the work is bins x places x kernel, not bins x shifts."""
    dim = shift_table(hist.sparkSession, most, bin_cents).filter(F.col("pos").isin(positions)).groupBy("bin", "shift").agg(F.sum("w").alias("w"))
    scores = hist.join(F.broadcast(dim), "bin").groupBy("clip_id", "shift").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    best = F.min_by(F.struct("shift", "score"), F.struct((-F.round("score", 9)).alias("s"), "shift"))
    return scores.groupBy("clip_id").agg(best.alias("b")).select("clip_id", "b.shift", "b.score")


def fold12(hist: DataFrame, bin_cents: int = 5) -> DataFrame:
    """(clip_id, vec): shares of the weight at the twelve places."""
    pos = (half_up(F.col("bin") * bin_cents / 100 - 1e-9) % 12).cast("int")
    by = hist.groupBy("clip_id", pos.alias("pos")).agg(F.sum("weight").alias("w"))
    return by.withColumn("share", F.col("w") / F.sum("w").over(_clip())).select("clip_id", "pos", "share")


def scale_matches(shares: DataFrame, scales: DataFrame, top: int = 5) -> DataFrame:
    """Cosine of the twelve shares with each scale's places; the best ``top`` of each clip, table order on ties."""
    places = scales.select("mela", F.size("positions").alias("n"), F.explode("positions").alias("pos"))
    norm = shares.groupBy("clip_id").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    dots = shares.join(F.broadcast(places), "pos").groupBy("clip_id", "mela", "n").agg(F.sum("share").alias("dot")).join(norm, "clip_id")
    scored = dots.select("clip_id", "mela", F.round(F.col("dot") / (F.col("norm") * F.sqrt("n")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("score"), "mela"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def notes(df: DataFrame, positions: list[int], labels: list[str], min_dur: float = 0.0, hop_s: float = HOP_S) -> DataFrame:
    """Runs of voiced frames nearest to one place: clip_id, idx, first_i, n, start_s, end_s, dur, label, pos, oct, cents, mean_cents, sd, slide, deviation, conf."""
    return notes_of_path(df.withColumn("state", F.when(F.col("voiced"), nearest_position(F.col("cents"), positions, labels))), min_dur, hop_s)


def notes_of_path(d: DataFrame, min_dur: float = 0.0, hop_s: float = HOP_S) -> DataFrame:
    """Runs of frames of one ``state`` (struct<cents,pos,label,oct>, null for silence), with statistics of those that have cents.

    Runs without cents or shorter than ``min_dur`` are dropped; they don't join their neighbours."""
    d = d.withColumn("__state", F.coalesce(F.col("state.cents"), F.lit(float("inf"))))
    d = d.withColumn("__new", F.coalesce((F.col("__state") != F.lag("__state").over(_order())).cast("int"), F.lit(1)))
    d = d.withColumn("__run", F.sum("__new").over(_order())).filter(F.col("state").isNotNull())
    place = Window.partitionBy("clip_id", "__run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("clip_id", "__run")
    d = d.withColumn("__k", F.count("cents").over(place)).withColumn("__n", F.count("cents").over(whole)).withColumn("__q", F.greatest(F.lit(1), F.floor(F.col("__n") / 4)))
    agg = d.groupBy("clip_id", "__run").agg(
        F.min("i").alias("first_i"), F.count("*").alias("n"), F.first("state.label").alias("label"), F.first("state.pos").alias("pos"), F.first("state.oct").alias("oct"), F.first("state.cents").alias("cents"),
        F.avg("cents").alias("mean_cents"), F.stddev_pop("cents").alias("sd"), F.median(F.when(F.col("__k") <= F.col("__q"), F.col("cents"))).alias("head"), F.median(F.when(F.col("__k") > F.col("__n") - F.col("__q"), F.col("cents"))).alias("tail"),
    ).filter("mean_cents is not null")
    out = agg.select(
        "clip_id", "first_i", "n", (F.col("first_i") * hop_s).alias("start_s"), ((F.col("first_i") + F.col("n")) * hop_s).alias("end_s"), (F.col("n") * hop_s).alias("dur"), "label", "pos", "oct", "cents", "mean_cents", "sd",
        (F.col("tail") - F.col("head")).alias("slide"), (F.col("mean_cents") - F.col("cents")).alias("deviation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / 160)).alias("conf"),
    ).filter(F.col("dur") >= min_dur - 1e-9)
    return out.withColumn("idx", (F.row_number().over(Window.partitionBy("clip_id").orderBy("first_i")) - 1).cast("long"))


def articulation(n: DataFrame) -> DataFrame:
    slide, sd = F.col("slide"), F.col("sd")
    return n.withColumn("artic", F.when((F.abs(slide) > 90) & (sd > 32), F.when(slide > 0, "slide-up").otherwise("slide-down")).when(sd > 48, "kampita").when(sd > 22, "light").otherwise("plain"))


def transit(n: DataFrame, most: float = 0.12, gap: float = 0.05, ratio: float = 1.5) -> DataFrame:
    """A short note on the way between two neighbours, close to both, one of them clearly longer."""
    w = Window.partitionBy("clip_id").orderBy("idx")
    before, after = F.lag(F.struct("cents", "dur", "end_s")).over(w), F.lead(F.struct("cents", "dur", "start_s")).over(w)
    d = n.withColumn("__a", before).withColumn("__b", after)
    way = (F.col("cents") - F.col("__a.cents")) * (F.col("__b.cents") - F.col("cents")) > 0
    near = (F.col("start_s") - F.col("__a.end_s") < gap) & (F.col("__b.start_s") - F.col("end_s") < gap)
    longer = (F.col("__a.dur") > ratio * F.col("dur")) | (F.col("__b.dur") > ratio * F.col("dur"))
    return d.withColumn("transit", F.coalesce((F.col("dur") < most - 1e-9) & way & near & longer, F.lit(False))).drop("__a", "__b")


def note_frames(n: DataFrame, frames: DataFrame, hop_s: float = HOP_S, value: str = "cents") -> DataFrame:
    """Frames with the label and ``value`` of the note over them (the later of two), by exploding notes to frames and an equality join."""
    last = half_up(F.col("end_s") / hop_s) - 1
    spans = n.select("clip_id", "idx", "label", value, half_up(F.col("start_s") / hop_s).alias("a"), last.alias("b")).filter("a <= b")
    at = spans.select("clip_id", "idx", "label", value, F.explode(F.sequence("a", "b")).alias("i")).groupBy("clip_id", "i").agg(F.max_by(F.struct("label", value), "idx").alias("note"))
    return frames.join(at, ["clip_id", "i"], "left").select(*[frames[c] for c in frames.columns], F.col("note.label").alias("note_label"), F.col(f"note.{value}").alias(f"note_{value}"))


def agreement(j: DataFrame) -> DataFrame:
    """(clip_id, scored, coverage, svara_accuracy, class_accuracy) of frames (gl, go, note_label, note_oct): label and octave, and label alone; 0 where nothing counts."""
    n, same = F.count("note_label"), F.col("note_label") == F.col("gl")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(F.coalesce(c, F.lit(False))), n), F.lit(0.0))
    return j.groupBy("clip_id").agg(n.alias("scored"), (n / F.count("*")).alias("coverage"), share(same & (F.col("note_oct") == F.col("go"))).alias("svara_accuracy"), share(same).alias("class_accuracy"))


def nearest_of(c: Column, positions: Column, labels: Column, temperament: str = "et", octaves: int = 3) -> Column:
    """struct<label,oct> of the nearest place of a scale in columns; the first in order of octave and place on ties."""
    table = F.array(*[F.lit(float(x)) for x in (JUST if temperament == "ji" else EQUAL)])
    each = F.flatten(F.transform(F.array(*[F.lit(o) for o in range(-octaves, octaves + 1)]), lambda o: F.transform(positions, lambda p, k: F.struct(F.abs(c - o * 1200 - F.get(table, p)).alias("d"), o.alias("oct"), k.alias("k")))))
    best = F.array_min(each)
    return F.struct(F.get(labels, best["k"]).alias("label"), best["oct"].alias("oct"))


def asof_nearest(left: DataFrame, right: DataFrame, by: str, on: str, value: str, floor_s: float = 0.005) -> DataFrame:
    """Adds ``value`` of the right row nearest in ``on`` (the earlier on ties) within max(mean step of the right side, floor_s); else 0.

    Both sides sorted together, up and down, as a frame that ends with its partition would be read anew for each row; no pair of rows is built. A right side of one row counts a step of 0.01."""
    step = right.groupBy(by).agg(F.when(F.count("*") > 1, (F.max(on) - F.min(on)) / (F.count("*") - 1)).otherwise(0.01).alias("__step"))
    both = left.withColumn("__r", F.lit(None).cast(f"struct<t:double,v:double>")).withColumn("__own", F.lit(1)).unionByName(
        right.select(by, on, F.struct(F.col(on).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("__r"), F.lit(0).alias("__own")), allowMissingColumns=True)
    up, down = Window.partitionBy(by).orderBy(on, "__own"), Window.partitionBy(by).orderBy(F.desc(on), F.desc("__own"))
    before = Window.unboundedPreceding
    d = both.withColumn("__a", F.last("__r", True).over(up.rowsBetween(before, 0))).withColumn("__b", F.last("__r", True).over(down.rowsBetween(before, -1))).filter("__own = 1")
    t = F.col(on)
    pick = F.when(F.col("__b").isNull() | (t - F.col("__a.t") <= F.col("__b.t") - t), F.col("__a")).otherwise(F.col("__b"))
    tol = F.greatest(F.col("__step"), F.lit(floor_s))
    return d.join(step, by, "left").withColumn("__p", pick).withColumn(value, F.coalesce(F.when(F.abs(F.col("__p.t") - t) <= tol, F.col("__p.v")), F.lit(0.0))).drop("__r", "__own", "__a", "__b", "__p", "__step")


def melody_scores(pairs: DataFrame, keys: list[str], tol: float = 50.0) -> DataFrame:
    """Voicing recall and false alarm, raw pitch and chroma accuracy, overall accuracy and octave errors of (est, gt) in Hz; 0 where nothing counts."""
    e, g = F.col("est") > 0, F.col("gt") > 0
    d = 1200 * F.log2(F.when(e, F.col("est")) / F.when(g, F.col("gt")))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    a = pairs.groupBy(*keys).agg(F.count("*").alias("frames"), n(g).alias("gv"), n(g & e).alias("tp"), n(~g & e).alias("fp"), n(g & e & (F.abs(d) <= tol)).alias("rpa"), n(g & e & (F.abs(fold_octave(d)) <= tol)).alias("rca"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    c = F.col
    return a.select(*keys, "frames", share(c("tp"), c("gv")).alias("voicing_recall"), share(c("fp"), c("frames") - c("gv")).alias("false_alarm"), share(c("rpa"), c("gv")).alias("raw_pitch"), share(c("rca"), c("gv")).alias("raw_chroma"),
                    share(c("rpa") + c("frames") - c("gv") - c("fp"), c("frames")).alias("overall"), share(c("rca") - c("rpa"), c("gv")).alias("octave_errors"))


def best_lag(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Scores at the lag of the estimate, -most to most frames, with the best raw pitch accuracy; the most negative on ties."""
    # Frames of a clip differ in i, so the frame at i + lag stands at most as many rows away: looked up in order, nothing is exploded before a join.
    here = F.struct("i", "est")
    d = pairs.withColumns({f"__{k}": F.lead(here, k).over(_order()) if k > 0 else F.lag(here, -k).over(_order()) if k else here for k in range(-most, most + 1)})
    rows = lambda lag: range(1, lag + 1) if lag > 0 else range(lag, 0) if lag else [0]
    at = [F.coalesce(*[F.when(F.col(f"__{k}.i") == F.col("i") + lag, F.struct(F.lit(lag).alias("lag"), F.col(f"__{k}.est").alias("est"))) for k in rows(lag)]) for lag in range(-most, most + 1)]
    d = d.select("clip_id", "gt", F.explode(F.array(*at)).alias("a")).filter("a is not null").select("clip_id", "gt", "a.lag", "a.est")
    scores = melody_scores(d, ["clip_id", "lag"])
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("raw_pitch"), "lag"))
    return scores.withColumn("__r", rank).filter("__r = 1").drop("__r")


def fold_reference(df: DataFrame, tonic: float, ceiling: float = 1900.0, rate: float = 0.1) -> DataFrame:
    """As ``fold_references`` with one tonic for all, and no gate."""
    return fold_references(df.withColumn("tonic_hz", F.lit(tonic)), F.lit(True), ceiling, rate).drop("tonic_hz")


def fold_references(df: DataFrame, on: Column, ceiling: float = 1900.0, rate: float = 0.1) -> DataFrame:
    """gt halved until at most ``ceiling`` cents over tonic_hz, in clips that are ``on`` and where more than ``rate`` of the voiced frames are above."""
    top = F.col("tonic_hz") * 2 ** (ceiling / 1200)
    sung = F.sum((F.col("gt") > 0).cast("int")).over(_clip())
    d = df.withColumn("high_rate", F.coalesce(F.try_divide(F.sum((F.col("gt") > top).cast("int")).over(_clip()), sung), F.lit(0.0)))
    fold = on & (F.col("high_rate") > rate) & (F.col("gt") > top)
    return d.withColumn("folded", F.when(fold, F.col("gt") / F.pow(F.lit(2.0), F.ceil(F.log2(F.col("gt") / top)))).otherwise(F.col("gt")))


def upper_median(values: Column) -> Column:
    """sorted[n div 2], which is not the mean of the two middle values."""
    a = F.array_sort(values)
    return F.get(a, (F.size(a) / 2).cast("int"))


def quantile_index(values: Column, q: float, default: float) -> Column:
    """sorted[floor(q * n)], without interpolation."""
    a = F.array_sort(values)
    return F.coalesce(F.get(a, F.floor(F.size(a) * q).cast("int")), F.lit(default))
