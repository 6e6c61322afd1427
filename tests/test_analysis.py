"""The whole analysis and the library operators on small cases that are known."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import music, talas
from tessitura.operators import analysis, audit, document, kernels, records, scales

SCHEMA = "clip_id long, i long, f0 double, conf double, rms double"
CLIP = "clip_id long, tonic_hz double, start_s double, name string, positions array<int>, labels array<string>, up array<string>, down array<string>"
MOHANAM = ([0, 2, 4, 7, 9], ["S", "R2", "G3", "P", "D2"])


def sung(spark, plan, tonic=146.8, sharp=0.0, clip=1):
    """Frames of a plan of (cents or None, frames)."""
    rows, i = [], 0
    for cents, n in plan:
        for _ in range(n):
            rows.append((clip, i, 0.0 if cents is None else tonic * 2 ** ((cents + sharp) / 1200), 0.95, 0.0 if cents is None else 0.3))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def clips(spark, rows=((1, 146.8),)):
    return spark.createDataFrame([(c, t, 0.0, "mohanam", *MOHANAM, MOHANAM[1], MOHANAM[1]) for c, t in rows], CLIP)


@pytest.mark.parametrize("sharp", [0.0, 30.0])
def test_notes_of_a_phrase(spark, sharp):
    """Svaras come out in order, also where the voice is 30 cents sharp: the tonic is corrected to within five."""
    plan = [(0, 20), (200, 20), (400, 20), (None, 30), (700, 25), (900, 20), (1200, 30)]
    done = analysis.finish_analysis(sung(spark, plan, sharp=sharp), clips(spark), music.melakartas(spark))
    notes = done.notes.orderBy("idx").collect()
    assert [(n.label, n.oct) for n in notes] == [("S", 0), ("R2", 0), ("G3", 0), ("P", 0), ("D2", 0), ("S", 1)]
    tonic = done.tonic.first()
    assert abs(tonic.shift - sharp) <= 5 and tonic.applied == (tonic.shift if sharp else 0)
    assert done.quality.first().notes == 6 and abs(done.quality.first().voiced_ratio - 135 / 165) < 1e-9
    assert [r.rank for r in done.suggestions.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_clips_without_voice_or_frames(spark):
    done = analysis.finish_analysis(sung(spark, [(None, 60)]), clips(spark, ((1, 146.8), (2, 100.0))), music.melakartas(spark))
    assert done.notes.count() == 0 and sorted((r.clip_id, r.applied) for r in done.tonic.collect()) == [(1, 0), (2, 0)]
    assert [(r.clip_id, r.notes, r.voiced_ratio) for r in done.quality.collect()] == [(1, 0, 0.0)]


def test_samples_to_notes(spark):
    rate = 16000
    hz = np.repeat([220.0, 220 * 2 ** (4 / 12), 220 * 2 ** (7 / 12)], rate // 2)
    pcm = np.sin(2 * np.pi * np.cumsum(hz) / rate)
    samples = spark.createDataFrame([(1, rate, pcm.tolist())], "clip_id long, sr int, pcm array<double>")
    done = analysis.analyze_samples(samples, clips(spark, ((1, 220.0),)), music.melakartas(spark))
    assert [n.label for n in done.notes.filter("dur > 0.2").orderBy("idx").collect()] == ["S", "G3", "P"]


def test_grammar_keeps_out_of_a_note_that_the_ascent_leaves_out():
    """Rising through a place that only the descent has costs; falling through it doesn't."""
    states, free = np.array([0.0, 200.0]), np.array([True, True])
    rise = np.repeat([0.0, 190.0], [6, 4])
    on, conf, flat, only = np.ones(10, bool), np.ones(10), np.zeros(10), np.array([True, False])
    assert 1 in kernels.viterbi(rise, on, conf, states, up=free, down=free, slope=flat)
    assert 1 not in kernels.viterbi(rise, on, conf, states, up=only, down=free, slope=flat, direction=60.0, silence=60.0)
    # Occupying it costs while the voice glides up, not down.
    glide = np.full(10, 5.0)
    assert 1 not in kernels.viterbi(rise, on, conf, states, up=only, down=free, slope=glide, direction=0.0, occupancy=60.0, silence=60.0)
    assert 1 in kernels.viterbi(rise, on, conf, states, up=only, down=free, slope=-glide, direction=0.0, occupancy=60.0, silence=60.0)


def test_viterbi_against_all_paths():
    r = np.random.default_rng(4)
    states = np.array([0.0, 200.0])
    for _ in range(20):
        cents, voiced, conf = r.choice([0.0, 90.0, 210.0], 6), r.random(6) < 0.8, r.random(6)

        def cost(path):
            total = 0.0
            for i, k in enumerate(path):
                if k == 2:
                    total -= 6.0 if voiced[i] else 0.0
                else:
                    total += -0.5 * ((cents[i] - states[k]) / 55) ** 2 * (0.35 + 0.65 * conf[i]) if voiced[i] else -6.0
                if i and path[i - 1] != k:
                    total -= 7.5 if 2 in (k, path[i - 1]) else 5.0
            return total

        got = [2 if k < 0 else int(k) for k in kernels.viterbi(cents, voiced, conf, states)]
        assert abs(cost(got) - max(cost(p) for p in product(range(3), repeat=6))) < 1e-9


def test_scores_of_a_perfect_record(spark):
    plan = [(0, 30), (200, 30), (400, 30), (700, 30)]
    f = sung(spark, plan)
    ref = f.select("clip_id", ((F.col("i") * 256 + 400) / 16000).alias("t_s"), F.col("f0").alias("hz"))
    both = clips(spark, ((1, 146.8), (2, 0.0), (3, 100.0)))
    named = music.melakartas(spark).withColumn("name", F.when(F.col("mela") == 28, "Mohana").otherwise("other"))
    s = analysis.score_records(f, ref, both, named, jitter=40.0)
    r = {x.clip_id: x for x in s.collect()}
    assert r[2].skipped == "no tonic annotation" and r[3].skipped == "segment too short" and r[1].skipped is None
    assert r[1].raw.raw_pitch == 1.0 and r[1].svara_accuracy > 0.95 and r[1].alignment_ok and r[1].octave_ok and r[1].tonic.residual <= 5
    one = analysis.summarize(s).first()
    assert (one.records, one.skipped, one.misaligned) == (1, 2, 0) and one.raw_pitch == 1.0
    assert analysis.summarize(s.filter("clip_id = 2")).first().raw_pitch == 0.0


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def tokens(s):
    return F.split(F.lit(s), " ")


def test_kinds_of_scales(spark):
    kind = lambda a, d: column(spark, scales.classify(tokens(a), tokens(d)))
    full = kind("S R2 G3 M1 P D2 N3 S", "S N3 D2 P M1 G3 R2 S")
    assert (full.kind, full.vakra, full.varja) == ("sampurna", False, [])
    assert kind("S R2 G3 P D2 S", "S D2 P G3 R2 S").kind == "audava" and kind("S R2 G3 P D2 S", "S D2 P G3 R2 S").varja == ["M", "N"]
    assert kind("S R2 M1 P N2 S", "S N2 D2 P M1 G3 R2 S").kind == "audava-sampurna"
    assert kind("S G3 R2 G3 M1 P S", "S P M1 G3 R2 S").kind == "audava vakra"
    assert [tuple(p) for p in column(spark, scales.scale_places(tokens("S R2 G3"), tokens("S G1 R2")))] == [(0, "S"), (2, "R2"), (4, "G3")]


def test_names_of_talas(spark):
    assert [column(spark, talas.match_tala(F.lit(x))) for x in ("Ādi tala", "Khanda Triputa", "miSra cApu", "Chaturasra Triputa", "nothing")] == ["Adi", "Khanda Triputa", "Misra chapu", "Adi", None]
    assert column(spark, talas.angas(F.lit("ekatala"))) == [4] and column(spark, talas.angas(F.lit("khandajatitriputa"))) == [5, 2, 2]
    assert column(spark, talas.engine_label(F.lit("khandajatitriputa"))) == "Khanda Triputa — 9 beats" and column(spark, talas.tala_and_jathi(F.lit("Misra chapu"))) is None


FAST = {
    "steady": ([0.3] * 8, []), "pair": ([0.3, 0.29, 0.31, 0.15, 0.14, 0.3, 0.29, 0.31], [(3, 4)]), "four": ([0.3, 0.29, 0.31, 0.075, 0.08, 0.07, 0.075, 0.3, 0.29, 0.31], [(3, 4, 5, 6)]),
    "tail": ([0.3, 0.29, 0.31, 0.14, 0.15, 0.3, 0.29], [(3, 4)]), "transit": ([0.3, 0.29, -0.05, 0.15, 0.14, 0.3, 0.29], [(3, 4)]),
}


@pytest.mark.parametrize("name", FAST)
def test_fast_notes(spark, name):
    durs, want = FAST[name]
    n = spark.createDataFrame([(1, i, abs(d), d < 0) for i, d in enumerate(durs)], "clip_id int, idx int, dur double, transit boolean")
    got = {}
    for r in document.group_fast(n, "clip_id", "idx", "dur", "transit").collect():
        if r.beat_group is not None:
            got.setdefault(r.beat_group, []).append(r.idx)
    assert sorted(tuple(sorted(v)) for v in got.values()) == want


def test_documents_leave_out_untyped_syllables(spark):
    rows = spark.createDataFrame([(1, 0, "Pallavi", 0, "S", 0, 1.0, "va"), (1, 0, "Pallavi", 1, "R", 1, 2.0, None), (1, 1, "Anupallavi", 0, "P", -1, 1.0, None)], "id int, section int, name string, pos int, s string, o int, d double, syl string")
    c = document.contributed(rows, "id").first()
    assert c.flat == "S R' P." and c.document.count('"syl"') == 1 and c.document.count("sectionStart") == 2
    with pytest.raises(Exception, match="not a token"):
        spark.range(1).select(document.flat_tokens(F.array(F.array(F.array(F.lit("Z")))))).collect()


def test_report_of_practice(spark):
    rows = [(1, "hit", float(d)) for d in (8, 6, 9, 7, 8)] + [(1, "none", None), (1, "near", 60.0), (1, "miss", 130.0)]
    r = audit.practice_report(spark.createDataFrame(rows, "clip int, verdict string, dev double"), "clip", 220.0).first()
    assert (r.targets, r.hits, r.percent, r.silent) == (8, 5, 63, 1) and r.lean == 8.0 and r.suggested_hz > 220


def test_bars_on_angas(spark):
    ok = lambda segs: column(spark, audit.marks_on_angas(F.array(*[F.lit(float(x)) for x in segs]), F.array(F.lit(4), F.lit(2), F.lit(2))))
    assert ok([4, 2, 2]) and ok([4, 2, 2, 4, 2, 2]) and ok([8, 4, 4]) and ok([2, 4, 2, 2]) and not ok([3, 3, 2]) and not ok([8]) and not ok([4, 2, 1])


def test_sections_and_evidence(spark):
    assert tuple(column(spark, records.classify_section(F.lit("Caraṇam sahānā")))) == ("Charanam", "composition", "sahānā")
    assert tuple(column(spark, records.classify_section(F.lit(" applause ")))) == ("applause", "other", None)
    files = spark.createDataFrame([("a", f"a/x{s}") for s in (".ctonic.txt", ".pitch.txt", ".json", ".sections-manual-p.txt", ".multitrack-vocal.mp3")] + [("b", "b/y.json")], "dir string, path string")
    got = {r.dir: (r.score, r.usable, r.annotated) for r in records.track_evidence(files, "dir", "path").collect()}
    assert got == {"a": (9, True, True), "b": (0, False, False)}


def test_alignment_rows_equal_plain_table():
    def plain(a, b):
        s = [[-float(i + j) if not i or not j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s[i][j] = max(s[i - 1][j - 1] + (2.0 if a[i - 1] == b[j - 1] else -1.0), s[i - 1][j] - 1, s[i][j - 1] - 1)
        return s[-1][-1]

    r = random.Random(3)
    for _ in range(50):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2))
        p = kernels.align(a, b)
        assert [i for i, _ in p if i >= 0] == list(range(len(a))) and [j for _, j in p if j >= 0] == list(range(len(b)))
        assert sum(-1.0 if i < 0 or j < 0 else 2.0 if a[i] == b[j] else -1.0 for i, j in p) == plain(a, b)
