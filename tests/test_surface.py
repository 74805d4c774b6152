"""Stores, imports, documents and readers that no query over the tables reaches."""

import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.functions import geo
from geotrail.operators import sequence
from geotrail.plans import queries_retrieval
from geotrail.sources import kml, match_store, readers, sinks


# --- verified candidates


def counted(spark):
    """A provider and the pairs that it was asked for."""
    asked = []

    def provider(pairs):
        asked.extend((r.q, r.r) for r in pairs.collect())
        return queries_retrieval.matches_by_rule(pairs)

    return provider, asked


def test_second_run_scores_nothing(spark, tmp_path):
    provider, asked = counted(spark)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (None, 4)], "q long, r long")
    store = match_store.MatchStore(spark, str(tmp_path / "m"))
    first = sorted(map(str, store.scored(pairs, provider).collect()))
    assert sorted(asked) == [(1, 2), (3, 4)] and len(first) == 4
    assert sorted(map(str, match_store.MatchStore(spark, str(tmp_path / "m")).scored(pairs, provider).collect())) == first and len(asked) == 2
    more = spark.createDataFrame([(3, 4), (5, 6)], "q long, r long")
    assert store.scored(more, provider).count() == 2 and asked[2:] == [(5, 6)]
    again = match_store.MatchStore(spark, str(tmp_path / "m"), recompute=True)
    assert sorted(map(str, again.scored(pairs, provider).collect())) == first and sorted(asked[3:]) == [(1, 2), (3, 4)]


def test_one_live_query_has_the_candidates_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    vec = lambda n: [(i, rng.normal(size=8).tolist(), float(i)) for i in range(n)]
    q, r = spark.createDataFrame(vec(6), "q long, v array<double>, t double"), spark.createDataFrame(vec(40), "r long, v array<double>, t double").withColumn("ord", F.col("r"))
    provider, asked = counted(spark)
    store = match_store.MatchStore(spark, str(tmp_path / "m"))
    batch = [x for x in match_store.verified_candidates(q, r, 5, provider, store).collect()]
    scored = len(asked)
    live = match_store.verified_candidates(q.where("q = 3"), r, 5, provider, store).collect()
    plain = lambda rows: sorted((x.q, x.r, round(x.sim, 9), x["rank"], x.lg_match_count, x.lg_inlier_ratio) for x in rows)
    assert plain(live) == plain(x for x in batch if x.q == 3) and len(live) == 5 and len(asked) == scored == 30


# --- matrices


@pytest.mark.parametrize("dtype", [np.float32, np.float64, np.float16])
def test_matrix_rows_are_read_by_ranges(spark, tmp_path, monkeypatch, dtype):
    monkeypatch.setattr(readers, "NPY_CHUNK", 100)
    m = np.arange(77 * 5, dtype=dtype).reshape(77, 5) / 4
    path = str(tmp_path / "m.npy")
    np.save(path, m)
    keys = spark.range(77).select(F.col("id").alias("i"), (F.col("id") * 3).alias("frame"))
    got = {r.i: (r.frame, r.v) for r in readers.import_descriptors(spark, path, keys, "i").collect()}
    assert len(got) == 77 and all(f == 3 * i and v == m[i].astype(np.float32).tolist() for i, (f, v) in got.items())
    for wrong in (keys.where("i < 76"), keys.withColumn("i", F.col("i") + 1), keys.union(keys.where("i = 0")).where("i <> 5")):
        with pytest.raises(ValueError, match="rows"):
            readers.import_descriptors(spark, path, wrong, "i")


def test_short_and_foreign_matrices_are_errors(spark, tmp_path):
    path = str(tmp_path / "m.npy")
    np.save(path, np.zeros((9, 4), np.float32))
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-1])
    with pytest.raises(ValueError, match="shorter"):
        readers.npy_header(path)
    for bad in (np.zeros(3), np.zeros((2, 2), np.int32), np.asfortranarray(np.ones((3, 2)))):
        np.save(path, bad)
        with pytest.raises(ValueError, match="no matrix"):
            readers.npy_header(path)
    np.save(path, np.zeros((0, 4), np.float32))
    assert readers.import_descriptors(spark, path, spark.range(0).withColumnRenamed("id", "i"), "i").count() == 0


# --- documents

NS = "{http://www.opengis.net/kml/2.2}"


def parsed(body, tmp_path):
    kml.write_document(body, str(tmp_path / "d"), "a <b> & c")
    (file,) = (tmp_path / "d").glob("part-*")
    doc = ET.parse(file).getroot().find(f"{NS}Document")
    assert doc.find(f"{NS}name").text == "a <b> & c"
    styles = [s.get("id") for s in doc.findall(f"{NS}Style")]
    named = {s.text[1:] for s in doc.iter(f"{NS}styleUrl")}
    assert sorted(styles) == sorted(named) and len(styles) == len(set(styles))
    return doc


def test_hybrid_document(spark, tmp_path):
    statuses = ["VPR_FIX", "SAT_FIX", "VPR_FALLBACK", "ODD"]
    rows = [(i, i / 2, statuses[i % 4], 32 + i * 1e-4, 35.0, None if i == 5 else 32 + i * 1e-4, 35.0 + i * 1e-5, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "frame_count long, time_s double, final_status string, gt_lat double, gt_lon double, final_lat double, final_lon double, final_error_m double").repartition(4)
    doc = parsed(kml.hybrid_document(df, 15), tmp_path)
    marks = doc.findall(f"{NS}Placemark")
    paths = {m.find(f"{NS}name").text: m.find(f"{NS}LineString/{NS}coordinates").text.split() for m in marks if m.find(f"{NS}LineString") is not None and m.find(f"{NS}name") is not None}
    assert {n: len(c) for n, c in paths.items()} == {"Ground truth path": 40, "VPR_FIX path": 10, "SAT_FIX path": 9, "VPR_FALLBACK path": 10}
    assert paths["Ground truth path"] == [f"35.00000000,{32 + i * 1e-4:.8f},0.00" for i in range(40)]
    points = [m for m in marks if m.find(f"{NS}Point") is not None]
    assert len(points) == 39 and points[0].find(f"{NS}description").text.split("\n")[:3] == ["Frame: 0  t=0.000000s", "Status: VPR_FIX", "Error: 0.0 m"]
    assert sum(m.find(f"{NS}styleUrl").text == "#error-line" for m in marks) == 15


def test_retrieval_document_and_no_rows(spark, tmp_path):
    frames = spark.createDataFrame([(i, 32.0 + i, 35.0, 32.0 + i, 35.5) for i in range(4)] + [(4, 0.0, 0.0, None, None)], "frame_count long, drone_latitude double, drone_longitude double, ground_latitude double, ground_longitude double")
    refs = spark.createDataFrame([("r&1", i, 33.0 + i, 36.0) for i in range(3)], "dataset_id string, frame_count long, ground_latitude double, ground_longitude double")
    results = spark.createDataFrame([(0, "r&1", 0, 7.0), (1, "r&1", 1, 9.0), (2, "r&1", 99, 50.0), (77, "r&1", 2, 60.0)], "query_frame_count long, reference_dataset string, reference_frame_count long, position_error_m double")
    doc = parsed(kml.retrieval_document(frames, results, refs, "Motion", 20), tmp_path)
    names = [m.find(f"{NS}name").text for m in doc.findall(f"{NS}Placemark")]
    assert names == ["Captured drone path", "True path of the video's centre", "Estimated path of the video's centre (Motion)", "Worst error #1: 9.0 m", "Worst error #2: 7.0 m"]
    assert "Matched reference: r&1 frame 1" in doc.findall(f"{NS}Placemark")[3].find(f"{NS}description").text
    assert len(list(parsed(kml.retrieval_document(frames.limit(0), results.limit(0), refs, "x"), tmp_path).iter(f"{NS}Placemark"))) == 0


def test_local_document_names_its_styles(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i), 32.0, 35.0, 32.1 if i > 2 else None, 35.1) for i in range(12)], "dataset_id string, frame_count long, start_seconds double, gt_lat double, gt_lon double, est_lat double, est_lon double")
    sinks.write_kml(sinks.point_placemarks(sinks.live_points(df), "label", "lat", "lon", "style"), str(tmp_path / "a.kml"), "x < y & z")
    doc = ET.parse(tmp_path / "a.kml").getroot().find(f"{NS}Document")
    assert doc.find(f"{NS}name").text == "x < y & z"
    assert {s.get("id") for s in doc.findall(f"{NS}Style")} == {s.text[1:] for s in doc.iter(f"{NS}styleUrl")} == {"truth-start", "estimate-start", "truth-dot", "estimate-dot"}


def test_tenths_are_those_of_the_exact_double(spark):
    values = [0.0, 0.05, 4.35, 4.25, 4.75, 0.25, 0.15, 12.349999, 12.35, 1e6 + 0.05, 99.95, 0.95] + [round(i * 0.01, 2) for i in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sinks.tenths(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.1f}" for r in got]


# --- readers


def test_tagged_manifests_tiles_and_frames(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text("frame_count,start_seconds\n1,0.5\n2,\n")
    got = readers.read_manifests(spark, [(n, str(tmp_path / f"{n}.csv")) for n in "ab"], "frame_count long, start_seconds double").collect()
    assert sorted((r.dataset_id, r.src_ord, r.frame_count, r.start_seconds) for r in got if r.frame_count == 1) == [("a", 0, 1, 0.5), ("b", 1, 1, 0.5)]
    (tmp_path / "18_1_2.json").write_text(json.dumps({"north": 1.0, "south": 0.0, "west": 2.0, "east": 3.0, "zoom": 18, "tile_x": 1, "tile_y": 2, "gsd_m": 0.5}, indent=2))
    assert readers.read_tiles(spark, str(tmp_path / "18_1_2.json")).first().tile_y == 2
    (tmp_path / "frames").mkdir()
    for n in ("f2_010.jpg", "f1_003.jpg", "x.png"):
        (tmp_path / "frames" / n).write_bytes(b"x")
    assert [(r.path[-10:], r.frame_number) for r in readers.list_frames(spark, str(tmp_path / "frames")).collect()] == [("f1_003.jpg", 1003), ("f2_010.jpg", 2010)]


def test_sequence_numbers_and_turns(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("a", 4, 0.0), ("b", 1, 0.0)], "dataset_id string, frame_count long, start_seconds double")
    assert sorted((r.dataset_id, r.frame_count, r.seq) for r in sequence.with_sequence(df).collect()) == [("a", 4, 0), ("a", 5, 1), ("b", 1, 0)]
    steps = spark.createDataFrame([(10.0, 0.0, 0.0, 10.0), (10.0, 0.0, -10.0, 0.0), (1.0, 0.0, 0.0, 10.0), (10.0, 0.0, 10.0, 0.0)], "ax double, ay double, bx double, b_y double")
    cost = geo.direction_cost(*[F.col(c) for c in ("ax", "ay", "bx", "b_y")], weight=1.0)
    assert [r[0] for r in steps.select(cost).collect()] == pytest.approx([4.0, 16.0, 0.0, 0.0])


def test_times_do_not_cross_flights(spark):
    """Flights count their frames alike: each row takes the time of its own flight."""
    times = spark.createDataFrame([("a", 1, 0, 10.0), ("b", 1, 0, 77.0)], "dataset_id string, frame_count long, seq long, start_seconds double")
    rows = spark.createDataFrame([("a", 1, 3), ("b", 1, 4), ("c", 1, 5)], "dataset_id string, frame_count long, seq long")
    assert {(r.dataset_id, r.time_s) for r in sequence.query_times(rows, times).collect()} == {("a", 10.0), ("b", 77.0), ("c", 5.0)}
