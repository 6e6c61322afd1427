"""Operators against small known answers and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import music, names
from tessitura.operators import frames as fr
from tessitura.operators import kernels
from tessitura.operators import library as lib
from tessitura.sources import text as src
from tessitura.streaming.practice import stabilise


def clip(spark, values, voiced=None):
    rows = [(1, i, v, True if voiced is None else voiced[i], 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "clip_id long, i long, cents double, voiced boolean, conf double")


def test_melakartas_are_72_scales():
    rows = music.melakarta_rows()
    assert len(rows) == 72 and len({tuple(p) for _, p, _ in rows}) == 72
    assert rows[28][1] == [0, 2, 4, 5, 7, 9, 11] and rows[14][1] == [0, 1, 4, 5, 7, 8, 11] and rows[64][1] == [0, 2, 4, 6, 7, 9, 11]
    assert all(p == sorted(p) and len(set(p)) == 7 for _, p, _ in rows)


def test_talas(spark):
    t = {(r.tala, r.jathi): r.cycle for r in music.talas(spark).collect()}
    assert len(t) == 35 and t["Triputa", "Chaturasra"] == 8 and t["Rupaka", "Chaturasra"] == 6 and t["Jhampa", "Chaturasra"] == 7 and t["Eka", "Tisra"] == 3 and t["Ata", "Khanda"] == 14
    b = music.talas(spark).filter("tala = 'Ata' and jathi = 'Khanda'").select(lib.anga_boundaries(F.col("angas"), F.col("beats")).alias("b")).first().b
    assert b == [5, 10, 12, 14]


def test_fold_octave(spark):
    r = spark.createDataFrame([(x,) for x in (600.0, 601.0, -600.0, 0.0, 1250.0)], "x double").select(music.fold_octave(F.col("x")).alias("y")).collect()
    assert [x.y for x in r] == [600.0, -599.0, 600.0, 0.0, 50.0]


def test_gap_fill_boundaries(spark):
    voiced = [False, True] + [False] * 6 + [True] + [False] * 7 + [True, False]
    rows = fr.gap_fill(clip(spark, [float(i * 10) for i in range(len(voiced))], voiced)).orderBy("i").collect()
    assert [r.voiced_filled for r in rows] == [False] + [True] * 8 + [False] * 7 + [True, False]
    assert all(abs(r.filled - 10 * r.i) < 1e-9 for r in rows[1:9])


def test_median_and_slope(spark):
    c = [0.0, 100.0, 20.0, 30.0]
    assert [r.smooth for r in fr.median_smooth(clip(spark, c)).orderBy("i").collect()] == [50.0, 20.0, 30.0, 25.0]
    assert [round(r.slope, 6) for r in fr.local_slope(clip(spark, c), 1).orderBy("i").collect()] == [100.0, 10.0, -35.0, 10.0]


def test_tonic_offset_of_a_shifted_scale(spark):
    cents = [float(p * 100 + 35) for p in (0, 2, 4, 5, 7, 9, 11) for _ in range(5)]
    hist = fr.smooth_histogram(fr.histogram(clip(spark, cents)))
    assert fr.tonic_offset(hist, [0, 2, 4, 5, 7, 9, 11]).first().shift == 35
    assert fr.tonic_offset(hist.limit(0), [0, 2, 4]).count() == 0
    total = hist.agg(F.sum("weight")).first()[0]
    assert abs(total - 35) < 1e-6


def test_scale_matches(spark):
    cents = [float(p * 100) for p in (0, 2, 4, 6, 7, 9, 11) for _ in range(5)]
    top = fr.scale_matches(fr.fold12(fr.histogram(clip(spark, cents))), music.melakartas(spark)).filter("rank = 1").first()
    assert top.mela == 65 and abs(top.score - 1) < 1e-6


def test_notes_and_transit(spark):
    runs = [(0, 20), (100, 4), (200, 20), (700, 10)]
    cents = [float(c) for c, n in runs for _ in range(n)]
    p, s = [0, 1, 2, 7], ["S", "R1", "R2", "P"]
    n = fr.transit(fr.articulation(fr.notes(clip(spark, cents), p, s))).orderBy("idx").collect()
    assert [(r.label, r.n, r.transit, r.artic) for r in n] == [("S", 20, False, "plain"), ("R1", 4, True, "plain"), ("R2", 20, False, "plain"), ("P", 10, False, "plain")]
    assert fr.notes(clip(spark, cents, [False] * len(cents)), p, s).count() == 0
    covered = fr.note_frames(fr.notes(clip(spark, cents), p, s), clip(spark, cents).select("clip_id", "i"))
    assert covered.filter("note_label is null").count() == 0 and covered.count() == len(cents)


def test_asof_nearest(spark):
    left = spark.createDataFrame([(1, float(t)) for t in (0.0, 0.5, 1.0, 1.5, 2.0, 9.0)], "k long, t double")
    right = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0), (1, 2.0, 30.0)], "k long, t double, hz double")
    assert [r.hz for r in fr.asof_nearest(left, right, "k", "t", "hz").orderBy("t").collect()] == [10.0, 10.0, 20.0, 20.0, 30.0, 0.0]


def test_fold_reference(spark):
    rows = [(1, i, 55.0 * 2 ** (c / 1200)) for i, c in enumerate([0] * 8 + [1950, 3150])]
    got = fr.fold_reference(spark.createDataFrame(rows, "clip_id long, i long, gt double"), 55.0).orderBy("i").collect()
    assert [round(1200 * np.log2(r.folded / 55)) for r in got][-2:] == [750, 750]
    rows = rows[:8] + [(1, 8, 440.0), (1, 9, 50.0)]
    assert fr.fold_reference(spark.createDataFrame(rows, "clip_id long, i long, gt double"), 55.0).filter("folded <> gt").count() == 0


def test_names(spark):
    pairs = [("Śaṅkarābharaṇaṁ", "Shankarabharanam"), ("Amṛta", "Amritha"), ("Kalyāṇi", "kalyani"), ("Gowla", "Gaula")]
    for r in spark.createDataFrame(pairs, "a string, b string").select(names.phonetic_key(F.col("a")).alias("a"), names.phonetic_key(F.col("b")).alias("b")).collect():
        assert r.a == r.b
    dim = spark.createDataFrame([(0, "Mohanam"), (1, "Mohana"), (2, "Hindolam"), (3, "Kharaharapriya")], "ord int, name string")
    got = {r.q: (r.match, r.distance) for r in lib.fuzzy_rank(spark.createDataFrame([(q,) for q in ("mohanam", "Hindholam", "Karaharapriya", "nothing", "")], "q string"), dim).collect()}
    assert got == {"mohanam": ("Mohanam", 0), "Hindholam": ("Hindolam", 0), "Karaharapriya": ("Kharaharapriya", 0), "nothing": (None, None), "": (None, None)}


def test_bars_from_an_anchor(spark):
    u = spark.createDataFrame([(1, i, 1, 0) for i in range(24)], "k long, n int, beats int, anchor int")
    levels = {r.n: r.level for r in lib.bar_levels(u, "k", "n", "beats", [4, 6, 8], "anchor").collect() if r.level}
    assert {n for n, x in levels.items() if x == "avartana"} == {0, 8, 16} and {n for n, x in levels.items() if x == "anga"} == {4, 6, 12, 14, 20, 22}
    levels = {r.n: r.level for r in lib.bar_levels(u.withColumn("anchor", F.lit(10)), "k", "n", "beats", [4, 6, 8], "anchor").collect() if r.level}
    assert {n for n, x in levels.items() if x == "avartana"} == {2, 10, 18}
    assert lib.bar_levels(u.withColumn("anchor", F.lit(None).cast("int")), "k", "n", "beats", [4, 6, 8], "anchor").filter("level is not null").count() == 0


def test_commas_judge_rows(spark):
    d = spark.createDataFrame([(0.2, None), (0.4, None), (2.0, None), (0.2, 5), (2.0, 0)], "d double, m int")
    assert [r.c for r in d.select(lib.comma_count(F.col("d"), F.lit(0.2), F.col("m")).alias("c")).collect()] == [0, 1, 7, 5, 0]
    cases = {"hit": [1.0, -2.0, 3.0, 0.0, 300.0], "near": [60.0] * 5, "miss": [-100.0] * 5, "none": [1.0, 2.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double").groupBy("k").agg(lib.judge(F.col("v")).alias("j")).collect()
    assert all(r.k == r.j for r in rows)
    cells = spark.createDataFrame([(1, i, i not in (3, 5)) for i in range(12)], "k long, n int, c boolean")
    assert {r["row"] for r in lib.wrap_rows(cells, "k", "n", "c").collect() if r.n <= 9} == {0} and lib.wrap_rows(cells, "k", "n", "c").agg(F.max("row")).first()[0] == 1
    assert spark.range(1).select(lib.lcm_of(F.array(F.lit(4), F.lit(6), F.lit(1))).alias("x")).first().x == 12
    ok = spark.createDataFrame([(16.0, 8.0), (10.0, 2.0), (0.0, 0.0), (9.0, 8.0)], "t double, f double").select(lib.duration_ok(F.col("t"), F.col("f"), F.lit(8)).alias("ok"))
    assert [r.ok for r in ok.collect()] == [True, True, False, False]


def tone(hz, n=9000, rate=16000):
    t = np.arange(n) / rate
    return sum(np.sin(2 * np.pi * hz * k * t) / k for k in (1, 2, 3))


def slow_yin(x, rate, at, window=800, fmin=70, fmax=900, threshold=0.15):
    most, least = min(rate // fmin, window - 1), max(2, rate // fmax)
    d = np.array([np.sum((x[at : at + window] - x[at + k : at + k + window]) ** 2) for k in range(most + 1)])
    run = np.cumsum(d)
    cm = np.array([1.0] + [d[k] * k / run[k] if run[k] > 0 else 1.0 for k in range(1, most + 1)])
    k = next((k for k in range(least, most + 1) if cm[k] < threshold), None)
    if k is None:
        k = least + int(np.argmin(cm[least:]))
    else:
        while k + 1 <= most and cm[k + 1] < cm[k]:
            k += 1
    f = float(k)
    if least < k < most and (den := 2 * (2 * cm[k] - cm[k + 1] - cm[k - 1])):
        f = k + (cm[k + 1] - cm[k - 1]) / den
    return rate / f, min(1, max(0, 1 - cm[k]))


@pytest.mark.parametrize("hz", [82.4, 146.83, 440.0])
def test_yin(hz):
    r = np.random.default_rng(1)
    x = tone(hz) + 0.05 * r.normal(size=9000)
    f0, conf, rms = kernels.yin(x, 16000)
    assert abs(1200 * np.log2(np.median(f0) / hz)) < 5 and conf.min() > 0.5 and len(rms) == len(f0)
    for i in (0, 7, len(f0) - 1):
        assert np.allclose((f0[i], conf[i]), slow_yin(x, 16000, i * 256), rtol=1e-6)
    part = kernels.yin(x, 16000, first=5, last=12)
    assert np.allclose(part[0], f0[5:12])
    assert len(kernels.yin(x[:1000], 16000)[0]) == 0 and (kernels.yin(np.zeros(4000), 16000)[1] <= 1).all()


def slow_viterbi(c, v, f, s, sigma=55.0, lam=5.0, sil=6.0):
    k = len(s)
    e = lambda i, q: (-sil if v[i] else 0.0) if q == k else (-0.5 * ((c[i] - s[q]) / sigma) ** 2 * (0.35 + 0.65 * f[i]) if v[i] else -sil)
    best, back = [e(0, q) for q in range(k + 1)], []
    for i in range(1, len(c)):
        new, ptr = [], []
        for q in range(k + 1):
            b, a = best[q], q
            for j in range(k + 1):
                if j != q and best[j] - (1.5 * lam if k in (j, q) else lam) > b:
                    b, a = best[j] - (1.5 * lam if k in (j, q) else lam), j
            new.append(b + e(i, q))
            ptr.append(a)
        best = new
        back.append(ptr)
    path = [int(np.argmax(best))]
    for ptr in back[::-1]:
        path.append(ptr[path[-1]])
    return [p if p < k else -1 for p in path[::-1]]


def test_viterbi_equals_the_plain_form():
    r = np.random.default_rng(4)
    for _ in range(20):
        n, s = r.integers(1, 40), np.sort(r.choice(np.arange(0, 1200, 100), 5, replace=False)).astype(float)
        c, v, f = r.uniform(0, 1200, n), r.random(n) < 0.8, r.random(n)
        assert kernels.viterbi(c, v, f, s).tolist() == slow_viterbi(c, v, f, s)
    assert kernels.viterbi(np.zeros(0), np.zeros(0, bool), np.zeros(0), np.zeros(3)).tolist() == []
    assert kernels.viterbi(np.zeros(3), np.ones(3, bool), np.ones(3), np.zeros(0)).tolist() == [-1] * 3


def test_repair_and_stabilise():
    c = np.array([500.0] * 10 + [1700.0] + [500.0] * 10)
    assert (kernels.repair(c, np.ones(21, bool)) == 500).all()
    c[10] = 1200.0
    assert kernels.repair(c, np.ones(21, bool))[10] == 1200.0 - 1200 * (abs(1200 - 500 - 1200) < 260)
    t = np.arange(40) * 0.02
    slip = np.where((t > 0.2) & (t < 0.28), 1700.0, 500.0)
    assert (stabilise(slip, t)[0] == 500).all()
    leap = np.where(t > 0.2, 1700.0, 500.0)
    assert stabilise(leap, t)[0][-1] == 1700


def test_align_and_octaves():
    assert kernels.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]
    assert kernels.align(list("abc"), list("ac")) == [(0, 0), (1, -1), (2, 1)]
    assert kernels.align([], list("a")) == [(-1, 0)]


def test_octave_paths(spark):
    from itertools import product

    r, rows = random.Random(2), []
    for k in range(40):
        p = [r.randrange(12) for _ in range(r.randrange(1, 6))]
        rows.append((k, p, [r.choice([None, None, -1, 0, 1]) for _ in p]))
    rows.append((99, [], []))
    got = {x.id: x.octaves for x in kernels.octave_resolver(spark.createDataFrame(rows, "id int, places array<int>, pins array<int>")).collect()}
    for k, p, pins in rows:
        cost = lambda o: sum(0.25 * abs(x) for x in o) + sum(abs(p[i] + 12 * o[i] - p[i - 1] - 12 * o[i - 1]) for i in range(1, len(p)))  # noqa: B023, E731
        best = min(cost(o) for o in product((-1, 0, 1), repeat=len(p)) if all(q is None or q == x for q, x in zip(pins, o)))
        assert len(got[k]) == len(p) and cost(got[k]) == best and all(q is None or q == x for q, x in zip(pins, got[k]))


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pitch.txt").write_text("0.0\t100.5\n\nbad line\n0.1, -3\n0.2 220\n")
    (tmp_path / "a/x.tonic.txt").write_text(" 146.8 Hz\n")
    (tmp_path / "s.txt").write_text("1.0\t1\t5.5\tPallavi\nx\t1\t2\tdrop\n0.5  1  2.0  Alapana\n")
    assert [(r.t_s, r.hz) for r in src.read_contour(spark, str(tmp_path / "a/x.pitch.txt")).orderBy("t_s").collect()] == [(0.0, 100.5), (0.1, 0.0), (0.2, 220.0)]
    assert src.read_tonic(spark, str(tmp_path / "a/x.tonic.txt")).first().tonic_hz == 146.8
    assert [(r.start_s, r.end_s, r.label) for r in src.read_sections(spark, str(tmp_path / "s.txt"), 4).collect()] == [(0.5, 2.5, "Alapana"), (1.0, 6.5, "Pallavi")]
    rec = src.list_records(spark, str(tmp_path / "a"), {"pitch": ".pitch.txt", "tonic": ".tonic.txt", "ctonic": ".ctonic.txt"}).collect()
    assert len(rec) == 1 and rec[0].pitch and rec[0].tonic and rec[0].ctonic is None
    lines = spark.createDataFrame([(1, n, v) for n, v in enumerate(["== Chakra ==", "| a || b", "skip", "=== Sub ===", "|c||d"])], "f int, n int, value string")
    assert [(r.heading, r.cells) for r in src.wikitable_rows(lines, "f", "n").orderBy("n").collect()] == [("Chakra", ["a", "b"]), ("Sub", ["c", "d"])]


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav(spark, tmp_path, bits):
    import struct

    x = np.array([0.0, 0.5, -0.5, 0.25])
    scale = 2 ** (bits - 1)
    raw = b"".join(bytes([int(v * 128 + 128)]) if bits == 8 else int(v * scale).to_bytes(bits // 8, "little", signed=True) for v in np.repeat(x, 2))
    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 8000 * 2 * bits // 8, 2 * bits // 8, bits)
    body = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 0xFFFFFFFF) + raw
    (tmp_path / "t.wav").write_bytes(body)
    (tmp_path / "bad.wav").write_bytes(b"nope")
    got = {r.file.rsplit("/", 1)[1]: r for r in src.read_wav(spark, str(tmp_path)).collect()}
    assert got["t.wav"].sr == 8000 and np.allclose(got["t.wav"].pcm, x, atol=1 / scale) and got["bad.wav"].error
    assert np.allclose(src.decode_wav(body, 1 / 8000, 2 / 8000)[1], x[1:3], atol=1 / scale)
