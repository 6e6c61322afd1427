"""Plans whose tasks must not grow with the input, or with the square of a group."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessitura.functions import talas
from tessitura.operators import analysis, audit, document, kernels, notation, scales
from tessitura.operators import frames as fr
from tessitura.operators.staging import dealt
from tessitura.plans import catalogue, catalogue_analysis, catalogue_document, catalogue_library, catalogue_sources
from tessitura.sources import text


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_by_bytes(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    few, many = dealt(t, "l_orderkey", each=1 << 30), dealt(t, "l_orderkey", each=5000)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < many.rdd.getNumPartitions()
    assert few.count() == many.count() == t.count()


def test_no_frame_ends_with_its_partition(spark):
    """Such a frame is read anew for every row: with the square of the group."""
    points = spark.range(3000).select(F.lit(1).alias("page"), "id", (F.col("id") * 0.5 + 0.25).alias("y"))
    bands = spark.range(70).select(F.lit(1).alias("page"), (F.col("id") * 2).cast("int").alias("band"), (F.col("id") * 20.0).alias("low"), (F.col("id") * 20.0 + 5).alias("high"))
    got = audit.nearest_band(points, bands, "page")

    def want(y):
        d, band = min((max(0.0, 20.0 * k - y, y - 20.0 * k - 5), 2 * k) for k in range(70))
        return band if d < 12 else None

    assert {r.id: r.band for r in got.collect()} == {k: want(k * 0.5 + 0.25) for k in range(3000)}
    assert "unboundedfollowing" not in plan(got)
    t = spark.range(50).select(F.lit(1).alias("clip_id"), (F.col("id") * 1.0).alias("t"), F.col("id").alias("v"))
    assert "unboundedfollowing" not in plan(fr.asof_nearest(t.drop("v"), t, "clip_id", "t", "v"))
    assert "unboundedfollowing" not in plan(notation.nearest_in_band(t.select("clip_id", F.col("t").alias("x")), t.select("clip_id", F.col("t").alias("x"), "v"), "clip_id", "x", "v", 2.5))
    c = spark.range(50).select(F.lit(1).alias("clip_id"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("cents"), (F.col("id") % 9 < 2).alias("voiced"))
    assert "unboundedfollowing" not in plan(fr.gap_fill(c))


def test_packed_texts(spark, tmp_path):
    rows = [("clip=1", "146.8 Hz\nA\\n\\\\s"), ("clip=2", "\tno\r\ntonic"), ("a\tb\\t", ""), ("clip=3", "  0.5")]
    text.pack(spark.createDataFrame([*rows, ("none", None)], "file string, value string"), str(tmp_path / "p"))
    assert sorted(map(tuple, text.unpacked(spark, str(tmp_path / "p")).collect())) == sorted([*rows, ("none", "")])
    got = {r.file: r.tonic_hz for r in text.read_tonic(spark, str(tmp_path / "p"), packed=True).collect()}
    assert got == {"clip=1": 146.8, "clip=2": None, "a\tb\\t": None, "clip=3": 0.5, "none": None}


def test_as_many_files_as_tasks(spark):
    """Not one for each clip."""
    clips = spark.range(0, 500, 1, 3).select(F.col("id").alias("clip"), F.lit("1 2").alias("line"))
    path = catalogue_sources._written(clips, spark, "many")
    assert sum(f.startswith("part-") for _, _, names in os.walk(path) for f in names) <= 3


def test_contours_and_sections_packed(spark, tmp_path):
    lines = [("a", "0.5\t220"), ("a", "broken"), ("b", "1.0\t-3")]
    text.pack(spark.createDataFrame(lines, "file string, value string"), str(tmp_path / "c"))
    assert sorted(map(tuple, text.read_contour(spark, str(tmp_path / "c"), packed=True).collect())) == [("a", 0.5, 220.0), ("b", 1.0, 0.0)]
    text.pack(spark.createDataFrame([("a", "2\t1\t3\tPallavi"), ("a", "x\t1\t3\tno")], "file string, value string"), str(tmp_path / "s"))
    assert [tuple(r) for r in text.read_sections(spark, str(tmp_path / "s"), 4, packed=True).collect()] == [("a", 2.0, 5.0, "Pallavi")]


def test_contributed_without_windows(spark, sf):
    got = catalogue_document.contributed_rows(spark, sf)
    assert plan(got).count("Window") == 1 == plan(got).count("Exchange")  # numbers of the lines alone
    assert "REPARTITION_BY_NUM" in plan(got)


def test_band_join_dealt_by_bytes(spark, sf):
    assert "REPARTITION_BY_NUM" in plan(catalogue.band_join_depth(spark, sf))


def test_structure_reads_a_document_once(spark):
    docs = spark.createDataFrame([(1, '{"tala":"Adi","gridFactor":2,"sections":[{"name":"x","svaras":[{"s":"S","o":1}]}]}'), (2, None)], "id int, document string")
    got = document.with_structure(docs, F.lit("two"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.id: r.document for r in got.collect()} == {1: '{"tala":"Adi","gridFactor":2,"sections":[{"name":"x","svaras":[{"s":"S","o":1}]}],"structure":"two"}', 2: None}


def test_talas_work_a_name_out_once(spark, sf):
    got = catalogue_library.tala_labels(spark, sf)
    assert "REPARTITION_BY_NUM" in plan(got)
    shown = spark.range(1).select(F.lit("khandajatitriputa").alias("x"), F.col("id")).filter("id >= 0").select(talas.display_tala(F.concat("x", F.col("id").cast("string"))).alias("s"))
    assert str(shown._jdf.queryExecution().analyzed().toString()).count("regexp_replace") <= 10
    assert shown.first().s == "Khanda Triputa — 9 beats"


def test_marks_are_hidden_without_joins(spark):
    rows = spark.createDataFrame([(1, [0, 7, 2], [None, 1, 0]), (2, [0], [None]), (3, [], [])], "id int, places array<int>, pins array<int>")
    got = kernels.verify_octaves(rows)
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    assert [r.id for r in got.collect()] == [1] and got.first().marked == 2


def test_frames_dealt_by_bytes(spark, sf):
    assert "REPARTITION_BY_NUM" in plan(catalogue.fold12_cosine_topk(spark, sf)) and "REPARTITION_BY_NUM" in plan(catalogue.frames(spark, sf))


def test_document_rows_without_windows(spark, sf):
    got = catalogue_document.document_rows(spark, sf)
    assert plan(got).count("Window") == 1 == plan(got).count("Exchange")
    whole = '{"sections":[{"name":"x","svaras":[{"s":"S"},{"s":"R","sectionStart":"y"},{"s":"G"}]},{"name":"none"},{"name":"z","svaras":[]},{"name":"w","svaras":[{"s":"P"}]}]}'
    docs = spark.createDataFrame([(1, whole), (2, "{}"), (3, None), (4, "no json")], "id int, document string")
    assert [(r.id, r.section, r.name, r.pos, r.s) for r in document.document_rows(docs, "id").orderBy("section", "pos").collect()] == [(1, 0, "x", 0, "S"), (1, 1, "y", 0, "R"), (1, 1, "y", 1, "G"), (1, 2, "w", 0, "P")]


def test_places_are_sorted_once(spark):
    d = spark.createDataFrame([(["S", "R2", "G3"], ["S", "G1", "R2"])], "a array<string>, d array<string>")
    got = d.select(scales.scale_places(F.col("a"), F.col("d")).alias("p"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_sort") == 1
    assert [tuple(x) for x in got.first().p] == [(0, "S"), (2, "R2"), (4, "G3")]


@pytest.mark.parametrize("name", ["tonic_correction", "scale_suggestions", "record_gate_scores"])
def test_results_without_notes(spark, sf, monkeypatch, name):
    """What rests on the contour alone decodes no path."""
    def none(*a, **k):
        raise AssertionError("decoded")

    monkeypatch.setattr(kernels, "decode_clips", none)
    assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("grammar", [True, False])
def test_paths_together_as_one_by_one(grammar):
    rng = np.random.default_rng(7)
    clips = []
    for n, k in ((40, 9), (1, 3), (17, 0), (40, 1), (66, 21)):
        states = np.sort(rng.choice(np.arange(-24, 24), k, replace=False)) * 100.0
        up, down = (rng.random(k) < 0.6 if grammar else None for _ in range(2))
        clips.append({"cents": np.round(rng.normal(0, 700, n), -2), "voiced": rng.random(n) < 0.8, "conf": np.round(rng.random(n), 1), "states": states, "up": up, "down": down, "slope": rng.normal(0, 9, n)})
    got = kernels.viterbi_all(clips, switch=1.5, sigma=80.0)
    for c, path in zip(clips, got):
        assert path.tolist() == kernels.viterbi(c["cents"], c["voiced"], c["conf"], c["states"], switch=1.5, sigma=80.0, up=c["up"], down=c["down"], slope=c["slope"]).tolist()


def test_clips_whole_in_any_batches():
    d = pd.DataFrame({"clip_id": [1] * 5 + [2] + [3] * 4, "__k": [1, 2, 3, 4, 5, 1, 1, 2, 3, 4]})
    for size in (1, 2, 3, 6, 10):
        parts = list(kernels.whole_clips(d.iloc[k : k + size] for k in range(0, 10, size)))
        assert pd.concat(parts, ignore_index=True).equals(d) and all(p["__k"].iloc[0] == 1 for p in parts)
        assert sum(len(kernels.spans(p)) for p in parts) == 3
    assert not list(kernels.whole_clips(iter([])))


def test_kernels_take_many_clips_at_once(spark, sf):
    """No group of a clip for Python, and no join of paths with frames."""
    got = plan(analysis.clean_contour(catalogue.frames(spark, sf), catalogue_analysis.clips(spark, sf)))
    assert "FlatMapGroups" not in got and "MapInPandas" in got


def test_lags_without_joins(spark):
    pairs = spark.createDataFrame([(1, i, 200.0 + 9 * i, 200.0 + 9 * (i - 2)) for i in (*range(12), 14, 15, 17)], "clip_id int, i long, est double, gt double")
    got = fr.best_lag(pairs)
    assert "Join" not in plan(got)
    assert (got.first().lag, got.first().frames, got.first().raw_pitch) == (-2, 11, 1.0)
