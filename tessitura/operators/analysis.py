"""The whole analysis of clips, from pitch frames (or samples) to notes, and its scores against reference contours.

Everything but octave repair and path decoding is native, and all steps are partitioned by clip, so one exchange serves them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.music import WINDOW, cents, frame_time
from tessitura.functions.names import resolved_key
from tessitura.operators import frames as fr
from tessitura.operators import kernels
from tessitura.operators.staging import staged


@dataclass(frozen=True)
class Config:
    """Decoding parameters. The defaults of the analysis."""

    min_conf: float = 0.5
    silence: float = 0.045
    sigma: float = 55.0
    switch: float = 5.0
    silence_penalty: float = 6.0
    direction: float | None = None
    occupancy: float = 2.2
    min_note: float = 0.06
    transient: float = 0.12
    grammar: bool = True
    auto_tonic: bool = True
    apply_from: int = 12
    temperament: str = "et"


class Analysis:
    """contour (clip_id, i, cents, voiced, conf), tonic (clip_id, shift, applied), suggestions (clip_id, mela, score, rank), notes, quality (a row a clip).

    Each is worked out when it is first read, with what it rests on alone; the contour and the notes are then written out once, as several results are read from them."""

    def __init__(self, frames: DataFrame, clips: DataFrame, scales: DataFrame, cfg: Config):
        self._frames, self._clips, self._scales, self._cfg = frames, clips, scales, cfg

    @cached_property
    def contour(self) -> DataFrame:
        return staged(clean_contour(self._frames, self._clips, self._cfg))

    @cached_property
    def _histogram(self) -> DataFrame:
        return fr.smooth_histogram(fr.histogram(self.contour))

    @cached_property
    def tonic(self) -> DataFrame:
        return tonic_shifts(self._histogram, self._clips, apply_from=self._cfg.apply_from, auto=self._cfg.auto_tonic, temperament=self._cfg.temperament)

    @cached_property
    def suggestions(self) -> DataFrame:
        return fr.scale_matches(fr.fold12(self._histogram), self._scales)

    @cached_property
    def notes(self) -> DataFrame:
        path = kernels.decode_clips(fr.local_slope(self.contour), self._clips.join(self.tonic, "clip_id"), self._cfg)
        return staged(fr.transit(fr.articulation(fr.notes_of_path(path, self._cfg.min_note)), self._cfg.transient))

    @cached_property
    def quality(self) -> DataFrame:
        by = self.contour.groupBy("clip_id").agg((F.count_if("voiced") / F.count("*")).alias("voiced_ratio"))
        n = self.notes.groupBy("clip_id").agg(F.avg(F.abs("deviation")).alias("d"), F.avg("conf").alias("c"), F.count("*").alias("n"))
        return by.join(n, "clip_id", "left").select("clip_id", F.coalesce("d", F.lit(0.0)).alias("mean_deviation"), F.coalesce("c", F.lit(0.0)).alias("mean_conf"), "voiced_ratio", F.coalesce("n", F.lit(0)).cast("long").alias("notes"))


def direction_labels(line: Column) -> Column:
    """The different labels of an ascending or descending line, marks stripped."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda t: F.regexp_replace(t, "[^A-Za-z0-9]", "")), lambda t: t != ""))


def clean_contour(frames: DataFrame, clips: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Voicing, cents over the clip's tonic, octave repair, median of three, short gaps filled. clips: (clip_id, tonic_hz, ...)."""
    d = frames.join(clips.select("clip_id", "tonic_hz"), "clip_id").withColumn("cents", cents(F.col("f0"), F.col("tonic_hz")))
    d = fr.voicing_mask(d, cfg.min_conf, cfg.silence).withColumn("voiced", F.col("voiced") & F.col("cents").isNotNull())
    d = kernels.repaired(d.select("clip_id", "i", "cents", "voiced", "conf"))
    d = fr.median_smooth(d).withColumn("cents", F.coalesce("smooth", "cents")).drop("smooth")
    return fr.gap_fill(d).select("clip_id", "i", F.coalesce("filled", "cents").alias("cents"), F.col("voiced_filled").alias("voiced"), "conf")


def tonic_shifts(hist: DataFrame, clips: DataFrame, most: int = 150, apply_from: int = 12, auto: bool = True, temperament: str = "et") -> DataFrame:
    """(clip_id, shift, applied) of every clip: where the places of its own scale meet most weight; applied if far enough, and 0 for clips without weight."""
    dim = fr.shift_table(hist.sparkSession, most, temperament=temperament)
    own = clips.select("clip_id", F.explode(F.array_distinct("positions")).alias("pos"))
    scores = hist.join(own, "clip_id").join(F.broadcast(dim), ["bin", "pos"]).groupBy("clip_id", "shift").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    best = scores.groupBy("clip_id").agg(F.min_by("shift", F.struct((-F.round("score", 9)).alias("s"), "shift")).alias("shift"))
    applied = F.when((F.abs("shift") >= apply_from) & F.lit(auto), F.col("shift")).otherwise(0)
    return clips.select("clip_id").join(best, "clip_id", "left").withColumn("shift", F.coalesce("shift", F.lit(0))).withColumn("applied", applied)


def finish_analysis(frames: DataFrame, clips: DataFrame, scales: DataFrame, cfg: Config = Config()) -> Analysis:
    """Pitch frames (clip_id, i, f0, conf, rms) to notes. clips: (clip_id, tonic_hz, positions, labels, up, down), one row each; scales: all that may be suggested.

    Clips without frames have a tonic row alone; clips whose frames are all unvoiced have no notes."""
    return Analysis(frames, clips, scales, cfg)


def analyze_samples(samples: DataFrame, clips: DataFrame, scales: DataFrame, cfg: Config = Config()) -> Analysis:
    """Clips (clip_id, sr, pcm) to notes: pitch tracking, then ``finish_analysis``."""
    return finish_analysis(kernels.yin_track(samples), clips, scales, cfg)


def align_reference(frames: DataFrame, reference: DataFrame, clips: DataFrame, window: int = WINDOW) -> DataFrame:
    """(clip_id, i, gt): the reference contour (clip_id, t_s, hz) at the centre of each frame, the excerpt's start added; 0 where nothing is near."""
    t = frame_time(F.col("i"), window=window) + F.coalesce("start_s", F.lit(0.0))
    left = frames.select("clip_id", "i").join(clips.select("clip_id", "start_s"), "clip_id").select("clip_id", "i", t.alias("t_s"))
    return fr.asof_nearest(left, reference.select("clip_id", "t_s", F.col("hz").alias("gt")), "clip_id", "t_s", "gt").select("clip_id", "i", "gt")


def tonic_score(applied: Column, configured_hz: Column, true_hz: Column) -> Column:
    """struct<true_offset,residual,uncorrected> in cents."""
    off = 1200 * F.log2(true_hz / configured_hz)
    return F.struct(off.alias("true_offset"), F.abs(off - applied).alias("residual"), F.abs(off).alias("uncorrected"))


def reference_gate(aligned: DataFrame, clips: DataFrame, low: float = 0.5, high: float = 2.4, least: int = 50) -> DataFrame:
    """(clip_id, ratio, octave_ok): the reference's upper median over the tonic, in range or too short to be judged. The lists are bounded by the clips."""
    g = aligned.groupBy("clip_id").agg(F.count_if(F.col("gt") > 0).alias("n"), F.collect_list(F.when(F.col("gt") > 0, F.col("gt"))).alias("a")).join(clips.select("clip_id", "tonic_hz"), "clip_id")
    ratio = fr.upper_median(F.col("a")) / F.col("tonic_hz")
    return g.select("clip_id", F.when(F.col("n") > least, ratio).alias("ratio"), ((F.col("n") <= least) | ratio.between(low, high)).alias("octave_ok"))


def known_clips(frames: DataFrame, clips: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Clips with ``frames`` and ``skipped``, why they aren't scored, and those that are."""
    count = frames.groupBy("clip_id").agg(F.count("*").alias("frames"))
    known = clips.join(count, "clip_id", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    known = known.withColumn("skipped", F.when(F.col("tonic_hz").isNull() | (F.col("tonic_hz") <= 0), "no tonic annotation").when(F.col("frames") < least, "segment too short"))
    return known, known.filter("skipped is null").drop("skipped", "frames")


def flat(jitter: float) -> Column:
    return F.col("tonic_hz") * 2 ** (-jitter / 1200)


def gated(own: DataFrame, reference: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gate of each clip, and its reference (clip_id, i, gt, folded, high_rate) folded where the gate is open. Both read the aligned reference, which is written out."""
    aligned = staged(align_reference(own, reference, used))
    gate = reference_gate(aligned, used)
    folded = fr.fold_references(aligned.join(gate, "clip_id").join(used.select("clip_id", "tonic_hz"), "clip_id"), F.col("octave_ok"))
    return gate, folded.select("clip_id", "i", "gt", "folded", "high_rate")


def folding(folded: DataFrame) -> DataFrame:
    return folded.groupBy("clip_id").agg(F.first("high_rate").alias("high_rate"), F.count_if(F.col("gt") != F.col("folded")).alias("folded_frames"))


def record_gates(frames: DataFrame, reference: DataFrame, clips: DataFrame, jitter: float = 0.0, least: int = 50) -> DataFrame:
    """What ``score_records`` tells of each clip without its analysis: (clip_id, frames, skipped, ratio, octave_ok, high_rate, folded_frames, true_offset)."""
    known, used = known_clips(frames, clips, least)
    gate, folded = gated(frames.join(used.select("clip_id"), "clip_id", "left_semi"), reference, used)
    off = used.select("clip_id", tonic_score(F.lit(0), flat(jitter), F.col("tonic_hz"))["true_offset"].alias("true_offset"))
    out = known.select("clip_id", "frames", "skipped")
    for part in (gate, folding(folded), off):
        out = out.join(part, "clip_id", "left")
    return out


def score_records(frames: DataFrame, reference: DataFrame, clips: DataFrame, scales: DataFrame, cfg: Config = Config(), jitter: float = 0.0, least: int = 50, floor: float = 0.2) -> DataFrame:
    """One row for each clip of ``clips`` (clip_id, tonic_hz, start_s, name, positions, labels, up, down): why it is skipped, or its gates and scores.

    The analysis gets a tonic that is ``jitter`` cents flat. The gates read the reference and a probe of fixed voicing, so no parameter moves them. Raw
    pitch is the tracker's, processed what the decoder reads. clips without a tonic or with fewer than ``least`` frames are skipped."""
    known, used = known_clips(frames, clips, least)
    wrong = used.withColumn("true_hz", F.col("tonic_hz")).withColumn("tonic_hz", flat(jitter))
    own = staged(frames.join(used.select("clip_id"), "clip_id", "left_semi"))
    done = finish_analysis(own, wrong, scales, cfg)
    gate, folded = gated(own, reference, used)
    folded = staged(folded)
    gt = folded.select("clip_id", "i", F.col("folded").alias("gt"))

    def lagged(hz: DataFrame, name: str) -> DataFrame:
        best = fr.best_lag(hz.join(gt, ["clip_id", "i"]))
        return best.select("clip_id", F.struct(*[c for c in best.columns if c != "clip_id"]).alias(name))

    voiced = lambda c, s: fr.voicing_mask(own, c, s).select("clip_id", "i", F.when(F.col("voiced"), F.col("f0")).otherwise(0.0).alias("est"))
    processed = done.contour.join(wrong.select("clip_id", "tonic_hz"), "clip_id").select("clip_id", "i", F.when(F.col("voiced") & F.col("cents").isNotNull(), F.col("tonic_hz") * F.pow(F.lit(2.0), F.col("cents") / 1200)).otherwise(0.0).alias("est"))
    probe = lagged(voiced(0.5, 0.045), "probe").select("clip_id", F.col("probe.raw_chroma").alias("chroma"))
    fold_rate = folding(folded)
    truth = gt.join(used.select("clip_id", "tonic_hz", "positions", "labels"), "clip_id").filter("gt > 0")
    truth = truth.withColumn("s", fr.nearest_of(cents(F.col("gt"), F.col("tonic_hz")), F.col("positions"), F.col("labels"), cfg.temperament)).select("clip_id", "i", F.col("s.label").alias("gl"), F.col("s.oct").alias("go"))
    svara = fr.agreement(fr.note_frames(done.notes.filter("not transit"), truth, value="oct"))
    rank = suggestion_rank(done.suggestions, used, scales)
    tonic = done.tonic.join(wrong.select("clip_id", F.col("tonic_hz").alias("configured"), "true_hz"), "clip_id").select("clip_id", "applied", tonic_score(F.col("applied"), F.col("configured"), F.col("true_hz")).alias("tonic"))
    out = known.select("clip_id", "frames", "skipped")
    for part in (lagged(voiced(cfg.min_conf, cfg.silence), "raw"), lagged(processed, "processed"), probe, gate, fold_rate, svara, rank, tonic, done.quality.select("clip_id", "notes")):
        out = out.join(part, "clip_id", "left")
    return out.withColumn("alignment_ok", F.when(F.col("skipped").isNull(), F.col("chroma") > floor))


def suggestion_rank(suggestions: DataFrame, clips: DataFrame, scales: DataFrame) -> DataFrame:
    """(clip_id, scale_rank): place, from 0, of the clip's scale among its suggestions by resolved name, -1 if it isn't there."""
    named = suggestions.join(F.broadcast(scales.select("mela", F.col("name").alias("suggested"))), "mela")
    hit = named.join(clips.select("clip_id", F.col("name").alias("wanted")), "clip_id").filter(resolved_key(F.col("suggested")) == resolved_key(F.col("wanted")))
    best = hit.groupBy("clip_id").agg((F.min("rank") - 1).cast("int").alias("r"))
    return clips.select("clip_id").join(best, "clip_id", "left").select("clip_id", F.coalesce("r", F.lit(-1)).alias("scale_rank"))


def summarize(scores: DataFrame) -> DataFrame:
    """One row: unweighted means over the records that pass both gates (0 without any), counts, and the ids of those that don't."""
    scored = F.col("skipped").isNull()
    ok = scored & F.col("alignment_ok") & F.col("octave_ok")
    off_octave = scored & ~F.col("octave_ok") & F.col("alignment_ok")
    folded = ok & (F.col("folded_frames") > 0)
    mean = lambda c: F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0))
    ids = lambda on: F.array_sort(F.collect_list(F.when(on, F.col("clip_id"))))
    share = lambda on: F.coalesce(F.try_divide(F.count_if(ok & on), F.count_if(ok)), F.lit(0.0))
    c = F.col
    return scores.agg(
        F.count_if(ok).alias("records"), F.count_if(~scored).alias("skipped"), F.count_if(scored & ~c("alignment_ok")).alias("misaligned"), F.count_if(off_octave).alias("octave_bad"),
        ids(scored & ~c("alignment_ok")).alias("misaligned_ids"), ids(off_octave).alias("octave_ids"), mean(c("raw.raw_pitch")).alias("raw_pitch"), mean(c("processed.raw_pitch")).alias("processed_pitch"),
        mean(c("processed.raw_chroma")).alias("processed_chroma"), mean(c("processed.octave_errors")).alias("octave_errors"), mean(c("processed.voicing_recall")).alias("voicing_recall"), mean(c("processed.false_alarm")).alias("false_alarm"),
        mean(c("svara_accuracy")).alias("svara_accuracy"), mean(c("class_accuracy")).alias("class_accuracy"), mean(c("coverage")).alias("coverage"), mean(c("tonic.residual")).alias("tonic_residual"),
        F.count_if(folded).alias("folded_records"), ids(folded).alias("folded_ids"), share(c("scale_rank") == 0).alias("top1"), share(c("scale_rank").between(0, 4)).alias("top5"),
    )

