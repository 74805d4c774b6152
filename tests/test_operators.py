"""Properties and edge rows of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geotrail.config import Costs
from geotrail.functions import geo
from geotrail.operators import decoding, fusion, gating, projection, raster, retrieval, sequence, smoothing
from geotrail.sources import providers, readers, sinks
from geotrail.streaming.causal import advance


def flight(spark, lats, lons=None, **more):
    rows = [("a", i, i, float(i), la, (lons or lats)[i]) for i, la in enumerate(lats)]
    df = spark.createDataFrame(rows, "dataset_id string, seq long, frame_count long, start_seconds double, raw_lat double, raw_lon double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def one(df, c):
    return [r[c] for r in df.orderBy("frame_count").collect()]


def test_local_xy_round_trip(spark):
    df = spark.createDataFrame([(32.1, 35.2), (-45.0, 170.0), (0.0, 0.0)], "lat double, lon double")
    x, y = geo.local_xy("lat", "lon", 30.0, 30.0)
    lat, lon = geo.from_local_xy(x, y, 30.0, 30.0)
    for r in df.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert r.lat == pytest.approx(r.a, abs=1e-9) and r.lon == pytest.approx(r.b, abs=1e-9)


def test_tiles_round_trip(spark):
    df = spark.createDataFrame([(32.1047, 35.2077), (-33.9, -70.1), (59.9, 10.7)], "lat double, lon double")
    t = raster.with_bbox(raster.with_tile(df, "lat", "lon")).collect()
    assert all(r.south <= r.lat <= r.north and r.west <= r.lon <= r.east for r in t)
    assert raster.neighbours(raster.with_tile(df, "lat", "lon")).count() == 27


def test_heading_and_distance_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (-5.0, 0.0)], "dx double, dy double")
    assert [r[0] for r in df.select(geo.heading(F.col("dx"), F.col("dy"))).collect()] == [None, 0.0, 90.0, 270.0]
    d = spark.createDataFrame([(0.0, 45.0), (-3.0, 45.0), (10.0, 0.0), (10.0, 45.0), (float("nan"), 45.0), (None, 45.0)], "a double, g double")
    got = [r[0] for r in d.select(geo.ground_distance("a", "g")).collect()]
    assert got[:3] == [0.0, 0.0, math.inf] and got[3] == pytest.approx(10.0) and math.isnan(got[4]) and got[5] is None
    with pytest.raises(ValueError):
        geo.ground_distance("a", "g", "sideways")


def test_causal_heading_reads_no_future(spark):
    lats = [32.0 + 1e-5 * (i * (i % 3)) for i in range(60)]
    df = flight(spark, lats).withColumnRenamed("raw_lat", "latitude").withColumnRenamed("raw_lon", "longitude")
    full = one(sequence.with_headings(sequence.with_local_xy(df)), "causal_heading")
    part = one(sequence.with_headings(sequence.with_local_xy(df.where("frame_count < 30"))), "causal_heading")
    assert full[:30] == part and full[0] is None


def test_projection_edges(spark):
    df = flight(spark, [32.0, 32.001, 32.002]).withColumnsRenamed({"raw_lat": "latitude", "raw_lon": "longitude"})
    df = df.withColumns({"rel_alt": F.when(F.col("seq") > 0, F.col("seq") * 10.0), "drone_yaw": F.lit(None).cast("double"), "gimbal_yaw": F.lit(None).cast("double"), "gimbal_pitch": F.lit(None).cast("double")})
    p = projection.ground_projection(df)
    assert p.count() == 3 and one(p, "ground_latitude")[0] is None
    assert projection.ground_projection(df.limit(0)).count() == 0
    assert projection.projection_summary(p).count() == 1


def test_nearest_in_time_ties_and_range(spark):
    frames = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 0.5), ("a", 3, 10.0), ("a", 4, 7.0), ("b", 5, 1.0)], "dataset_id string, frame_count long, start_seconds double")
    points = spark.createDataFrame([("a", 0, 4.0, "x"), ("a", 1, 6.0, "y"), ("a", 2, 7.0, "z"), ("a", 3, 7.0, "w"), ("a", 4, 1.0, "v")], "dataset_id string, seq long, start_seconds double, name string")
    got = {r.frame_count: r.name for r in sequence.nearest_in_time(frames, points, ["name"]).collect()}
    assert got == {1: "x", 4: "z"}
    got = {r.frame_count: r.name for r in sequence.nearest_in_time(frames, points, ["name"], inside=False).collect()}
    assert got == {1: "x", 2: "v", 3: "z", 4: "z", 5: None}


def test_smoothing_properties(spark):
    df = flight(spark, [1.0, None, 3.0, 2.0, None, 5.0])
    assert one(df.withColumn("s", smoothing.symmetric("raw_lat", 0)), "s") == [1.0, None, 3.0, 2.0, None, 5.0]
    live = smoothing.live_path(flight(spark, [None, 1.0, None, 3.0]), 2)
    assert one(live, "filled_lat") == [None, 1.0, 1.0, 3.0]
    s = one(live, "smoothed_lat")
    assert s[0] is None and s[1] == 1.0 and 1.0 < s[3] < 3.0
    assert one(flight(spark, [None, 2.0, None]).withColumn("f", smoothing.fill_batch("raw_lat")), "f") == [2.0, 2.0, 2.0]
    assert one(flight(spark, [None, None]).withColumn("f", smoothing.fill_batch("raw_lat")), "f") == [0.0, 0.0]


def test_interpolation_holds_ends(spark):
    p = smoothing.interpolate(flight(spark, [None, 1.0, None, 3.0, None]))
    assert one(p, "est_latitude") == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert one(p, "method") == ["INTERPOLATED", "FIX", "INTERPOLATED", "FIX", "INTERPOLATED"]
    assert one(smoothing.interpolate(flight(spark, [None, None])), "est_latitude") == [None, None]


def test_stream_step_equals_batch(spark):
    lats = [None, 1.0, None, 3.0, 2.0, None, None, 4.0, 9.0, 1.0]
    batch = one(smoothing.live_path(flight(spark, lats), 2), "smoothed_lat")
    rows = pd.DataFrame({"dataset_id": 1, "frame_count": range(10), "raw_lat": lats, "raw_lon": lats})
    a, la, lo = advance(rows[:4], [], [], 2)
    b, _, _ = advance(rows[4:], la, lo, 2)
    got = [*a["smoothed_lat"], *b["smoothed_lat"]]
    assert math.isnan(got[0]) and got[1:] == pytest.approx(batch[1:])


def random_candidates(seed, n=9, k=4):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=k) for _ in range(n)], [rng.normal(scale=40, size=(k, 2)) for _ in range(n)]


def brute(unary, xy, cfg, second):
    from itertools import product

    def cost(path):
        c = sum(unary[i][p] for i, p in enumerate(path))
        for i in range(1, len(path)):
            c += decoding._step(xy[i - 1], xy[i], cfg)[path[i - 1], path[i]]
        if second:
            for i in range(2, len(path)):
                c += decoding._bend(xy[i - 2], xy[i - 1], xy[i], cfg)[path[i - 2], path[i - 1], path[i]]
        return c

    return min(product(*[range(len(u)) for u in unary]), key=cost)


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_is_optimal(seed):
    unary, xy = random_candidates(seed, n=6)
    cfg = Costs(direction_weight=0.5)
    assert tuple(decoding.first_order(unary, xy, cfg)) == brute(unary, xy, cfg, False)
    assert tuple(decoding.second_order(unary, xy, cfg)) == brute(unary, xy, cfg, True)
    plain = Costs(acceleration_weight=0.0)
    assert decoding.second_order(unary, xy, plain) == decoding.first_order(unary, xy, plain)


@pytest.mark.parametrize("seed", range(4))
def test_online_with_long_lag_is_offline(seed):
    unary, xy = random_candidates(seed)
    assert decoding.second_order(unary, xy, Costs(), lag=20) == decoding.second_order(unary, xy, Costs())
    prefix = decoding.second_order(unary[:6], xy[:6], Costs(), lag=2)
    assert decoding.second_order(unary, xy, Costs(), lag=2)[:4] == prefix[:4]


def test_retrieval_ties_and_few_references(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 0.0)], "q long, v array<double>, t double")
    r = spark.createDataFrame([(10, [1.0, 0.0], 5.0, 0), (11, [1.0, 0.0], 50.0, 1), (12, [0.0, 1.0], 0.5, 2)], "r long, v array<double>, t double, ord long")
    rank = lambda df: [x.r for x in df.orderBy("rank").collect()]
    assert rank(retrieval.top_references(q, r, 10)) == [11, 10, 12]
    assert rank(retrieval.top_references(q, r, 2, max_gap_s=1.0)) == [12]
    assert rank(retrieval.top_references(q, r, 2, max_gap_s=0.1)) == [11, 10]
    assert retrieval.top_references(q, r.limit(0), 2).count() == 0


def test_gate_without_fix_and_plan(spark):
    rows = spark.createDataFrame([("a", 0.0, 0, 9, 1, 0.1, 0.1, 5.0), ("a", 9.0, 1, 9, 1, 0.1, 0.1, 7.0)], "dataset_id string, start_seconds double, frame_count long, rank int, lg_inlier_count int, lg_inlier_ratio double, sim double, error_m double")
    s = gating.policy_summaries(rows)
    assert s.count() == 750 and s.where("accepted_fixes > 0 or longest_gap_s <> 9").count() == 0
    assert gating.best_policies(s).first().grid_ord == 0
    assert "CartesianProduct" not in s._jdf.queryExecution().toString()


def test_fusion_without_sources_is_null(spark):
    m = spark.createDataFrame([(1, 32.0, 35.0)], "frame_count long, gt_lat double, gt_lon double")
    none = lambda ddl: spark.createDataFrame([], ddl)
    r = fusion.fuse(m, none("frame_count long, decision string"), none("frame_count long, vpr_lat double, vpr_lon double"), none("frame_count long, sat_status string, sat_lat double, sat_lon double"), ["frame_count"]).first()
    assert (r.final_status, r.final_lat, r.final_error_m) == ("VPR_FALLBACK", None, None)


def test_readers_and_sinks(spark, tmp_path):
    srt = tmp_path / "v1.SRT"
    good = "1\n00:00:00,033 --> 00:00:00,066\nFrameCnt: 7, DiffTime: 33ms\n2024-01-01 10:00:00.123\n[iso: 100] [shutter: 1/60.0] [color_md: 5] [latitude: 32.5] [longitude: 35.5] [rel_alt: 1.5 abs_alt: 2.5] [iso: 200]"
    srt.write_text("\n\n".join([good, "x\nnot a block\nat all", "3\nno time\nbody", good.replace("1\n00", "4\n00", 1)]), encoding="utf-8-sig")
    rows = readers.read_srt(spark, str(srt)).orderBy("subtitle_index").collect()
    assert [r.subtitle_index for r in rows] == [1, 4]
    r = rows[0]
    assert (r.dataset_id, r.start_seconds, r.frame_count, r.iso, r.shutter, r.color_md, r.rel_alt, r.abs_alt, r.fnum) == ("v1", 0.033, 7, 200.0, "1/60.0", "5.0", 1.5, 2.5, None)
    df = spark.createDataFrame([(2, 1.5, None), (1, float("nan"), "a<b>&'\"")], "k long, x double, s string")
    sinks.write_csv(df, str(tmp_path / "out"), ["k"])
    back = readers.read_table(spark, str(tmp_path / "out"), "k long, x double, s string").collect()
    assert [b.k for b in back] == [1, 2] and math.isnan(back[0].x)
    assert df.orderBy("k").select(sinks.escape(F.col("s"))).first()[0] == "a&lt;b&gt;&amp;&#x27;&quot;"
    sinks.write_json_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "s.json"))
    assert '"n" : 2' in (tmp_path / "s.json").read_text()
    path = flight(spark, [32.0, 32.1, 0.0, float("nan")])
    lines = sinks.line_string(path, "dataset_id", "raw_lat", "raw_lon", "seq")
    assert lines.first().coordinates == "32.00000000,32.00000000,0.00 32.10000000,32.10000000,0.00"
    sinks.write_kml(sinks.placemarks(lines, "dataset_id"), str(tmp_path / "p.kml"), "t")
    assert "<LineString>" in (tmp_path / "p.kml").read_text()
    sinks.write_svg(sinks.svg_fit(path.where("raw_lat > 0"), "raw_lat", "raw_lon"), str(tmp_path / "p.svg"), "seq")
    assert "polyline" in (tmp_path / "p.svg").read_text()


def test_providers_score_each_key_once(spark):
    table = spark.createDataFrame([(1, "x")], "k long, v string")
    rows = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    got = providers.scored_once(providers.from_table(table, ["k"]), ["k"])(rows)
    assert sorted((r.k, str(r.v)) for r in got.collect()) == [(1, "x"), (1, "x"), (2, "None")]


def test_grid_numbers_follow_nesting_order(spark):
    from itertools import product

    grid = gating.Grid((1, 2), (50, 100, 150), (0.5,), (0.9, 0.95))
    rows = spark.range(1).select(F.explode(grid.numbers()).alias("k")).select(grid.policy(F.col("k")).alias("p")).select("p.*").orderBy("grid_ord").collect()
    assert [tuple(r)[1:] for r in rows] == list(product(*grid.parts)) and [r.grid_ord for r in rows] == list(range(12))


def test_camera_values(spark):
    d = spark.range(1).select(geo.ground_distance(F.lit(118.0), 60.0).alias("d"), geo.haversine(32.0, 35.0, 32.0, 35.0).alias("z"), geo.gsd_at_centre(F.lit(-1.0)).alias("g")).first()
    assert d.d == pytest.approx(118 / math.tan(math.radians(60))) and d.z == 0.0 and d.g == 0.0
    w, depth = spark.range(1).select(*geo.footprint(F.lit(100.0), 0.0)).first()
    assert w == math.inf and depth == math.inf
    m = geo.camera_matrix(1920, 1080)
    assert m["fx"] == pytest.approx(m["fy"]) and (m["cx"], m["cy"]) == (960.0, 540.0)


def test_subtitle_forms(spark):
    blocks = [
        "1\n00:00:01,000 --> 00:00:02,000\nFrameCnt : 7, DiffTime : 33ms 2024-01-01  10:00:00.123456 [iso: 100] [iso: 200] [rel_alt: 1.5 abs_alt: 2.5]",
        "2\n00:00:01,000 --> 00:00:02,000\nSrtCnt:8, DiffTime:40ms 2024-01-01 10:00:00.12 [shutter: 1/50]",
        "3\n00:00:01,000-->00:00:02,000\nFrameCnt: 9, DiffTime: 33ms",
    ]
    df = spark.createDataFrame([(b,) for b in blocks], "block string")
    got = readers.parse_blocks(df).orderBy("subtitle_index").collect()
    assert [(r.frame_count, r.diff_time_ms, r.timestamp) for r in got] == [(7, 33, "2024-01-01  10:00:00.123456"), (8, 40, "2024-01-01 10:00:00.12")]
    assert (got[0].iso, got[0].rel_alt, got[0].abs_alt, got[1].shutter) == (200.0, 1.5, 2.5, "1/50")


def test_error_lines_reach_both_reports(spark, tmp_path):
    rows = [("a", i, 32.0 + i / 1e4, 35.0, 32.0 + i / 1e4, 35.0 + i / 1e5, float(i)) for i in range(4)] + [("a", 4, 32.1, 35.1, None, None, None)]
    df = spark.createDataFrame(rows, "dataset_id string, seq long, gt_lat double, gt_lon double, est_lat double, est_lon double, error_m double").withColumn("name", F.format_string("frame %d & more", "seq"))
    xml = [r.xml for r in sinks.error_placemarks(df, "name", "seq", n=2).collect()]
    assert [x[:42] for x in xml] == ["<Placemark><name>frame 3 &amp; more</name>", "<Placemark><name>frame 2 &amp; more</name>"]
    assert "35.00000000,32.00030000,0.00 35.00003000,32.00030000,0.00" in xml[0]
    points = sinks.svg_fit(df.withColumn("x", F.col("seq") * 10.0).withColumn("y", F.col("seq") * 5.0), "x", "y")
    lines = sinks.error_lines(points.withColumn("est_x", F.when(F.col("est_lat").isNotNull(), F.col("svg_x") + 1)).withColumn("est_y", F.col("svg_y")))
    assert lines.count() == 4
    sinks.write_svg(points, str(tmp_path / "a.svg"), "seq", errors=lines)
    assert (tmp_path / "a.svg").read_text().count('stroke="red"') == 4


def test_live_points_of_a_flight_without_a_fix_and_one_that_begins_late(spark):
    df = spark.createDataFrame([(d, i, float(i), 32.0, 35.0, 32.1 if d == "b" and i >= 40 else None, 35.1) for d in "ab" for i in range(45)], "dataset_id string, frame_count long, start_seconds double, gt_lat double, gt_lon double, est_lat double, est_lon double")
    got = {(r.dataset_id, r.idx, r.label) for r in sinks.live_points(df).collect()}
    dots = {(d, i, f"truth +{i} s") for d in "ab" for i in range(0, 30, 5)}
    assert got == dots | {("a", 0, "truth begins"), ("b", 0, "truth begins"), ("b", 40, "estimate begins at row 40")}
    assert sinks.live_points(df.limit(0)).count() == 0


def test_times_and_paths_take_the_last_of_equal_keys(spark):
    times = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (None, 2, 7.0)], "frame_count long, seq long, start_seconds double")
    got = sequence.query_times(spark.createDataFrame([(1, 8), (2, 9), (None, 10)], "frame_count long, seq long"), times).collect()
    assert {(r.frame_count, r.time_s) for r in got} == {(1, 6.0), (2, 9.0), (None, 10.0)}
    refs = spark.createDataFrame([(0, 5, "p", 1.0, 2.0), (1, 0, "p", 3.0, 4.0), (0, 0, None, 5.0, 6.0)], "src_ord int, seq long, frame_path string, ground_latitude double, ground_longitude double")
    got = retrieval.position_by_path(spark.createDataFrame([("p",), ("x",), (None,)], "reference_frame_path string"), refs).collect()
    assert {(r.reference_frame_path, r.ref_lat, r.ref_lon) for r in got} == {("p", 3.0, 4.0), ("x", None, None), (None, None, None)}
