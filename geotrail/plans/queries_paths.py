"""Queries over telemetry and fixes: parsing, projection, alignment, smoothing, fusion and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Projection
from ..functions import geo
from ..operators import fusion, gating, projection, raster, scans, sequence, smoothing
from ..sources import kml, readers, sinks
from . import oracle as o
from . import views
from .registry import query, rounded, rounded_sql

B = o.BASE
CFG = Projection(camera_angle_deg=60.0, heading_source="auto", camera_angle_source="auto")


@query(f"""{B} SELECT event_id + 1 AS subtitle_index, CAST((event_id // 3600) * 3600 + (event_id // 60 % 60) * 60 + event_id % 60 AS DOUBLE) + (event_id % 1000) / 1000.0::DOUBLE AS start_seconds,
  event_id AS frame_count, CAST(33 AS BIGINT) AS diff_time_ms, '2024-01-01 00:00:00.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS "timestamp", CAST(k AS DOUBLE) AS iso,
  '1/' || CAST(k + 50 AS VARCHAR) || '.0' AS shutter, CAST('32.' || CAST(104000 + event_id % 1000 AS VARCHAR) AS DOUBLE) AS latitude, CAST('35.' || CAST(207000 + event_id % 997 AS VARCHAR) AS DOUBLE) AS longitude,
  k + 0.5::DOUBLE AS rel_alt, k + 600.5::DOUBLE AS abs_alt FROM ev WHERE event_type <> 'error'""")
def srt_parse(spark, sf):
    t = readers.parse_blocks(views.subtitle_blocks(spark, sf))
    return t.select("subtitle_index", "start_seconds", "frame_count", "diff_time_ms", "timestamp", "iso", "shutter", "latitude", "longitude", "rel_alt", "abs_alt")


@query(f"{B} SELECT event_id, lpad(CAST(event_id // 3600 AS VARCHAR), greatest(2, length(CAST(event_id // 3600 AS VARCHAR)))::INTEGER, '0') || ':00:05,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS t, CAST((event_id // 3600) * 3600 AS DOUBLE) + 5 + (event_id % 1000) / 1000.0::DOUBLE AS seconds FROM ev")
def srt_time(spark, sf):
    i = F.col("event_id")
    t = F.concat(views.srt_hours(i), F.lit(":00:05,"), F.lpad((i % 1000).cast("string"), 3, "0"))
    return views.events(spark, sf).select("event_id", t.alias("t")).withColumn("seconds", readers.srt_seconds(F.col("t")))


@query(f"{B} SELECT event_id, CAST(k AS VARCHAR) AS iso, CAST(k AS VARCHAR) || '.5' AS rel_alt, CAST(k + 600 AS VARCHAR) || '.5' AS abs_alt, CAST(6 AS INTEGER) AS n_keys FROM ev")
def bracket_metadata(spark, sf):
    m = views.subtitle_blocks(spark, sf).withColumn("e", readers.bracket_entries(F.col("block"))).withColumn("m", readers.bracket_metadata(F.col("e")))
    return m.select("event_id", F.col("m")["iso"].alias("iso"), F.col("m")["rel_alt"].alias("rel_alt"), F.col("m")["abs_alt"].alias("abs_alt"), F.size("m").alias("n_keys"))


@query(f"""{B} SELECT dataset_id, count(*) AS row_count, count(*) FILTER (latitude <> 0) AS valid_gps_rows, arg_min(start_seconds, CASE WHEN latitude <> 0 THEN seq END) AS first_valid_seconds,
  arg_max(start_seconds, seq) AS duration_seconds, min(latitude) AS latitude_min, max(latitude) AS latitude_max, min(longitude) AS longitude_min, max(longitude) AS longitude_max, min(rel_alt) AS rel_alt_min, max(rel_alt) AS rel_alt_max FROM tel GROUP BY dataset_id""")
def telemetry_summary(spark, sf):
    return projection.telemetry_summary(views.telemetry(spark, sf))


@query(f"{B} SELECT dataset_id, frame_count FROM valid")
def valid_gps_filter(spark, sf):
    return sequence.valid_gps(views.telemetry(spark, sf)).select("dataset_id", "frame_count")


def _valid(spark, sf) -> DataFrame:
    return sequence.valid_gps(views.telemetry(spark, sf))


@query(f"{B} SELECT {rounded_sql('dataset_id frame_count', 'x_m y_m')} FROM vxy")
def local_xy(spark, sf):
    return rounded(sequence.with_local_xy(_valid(spark, sf)), "dataset_id frame_count", "x_m y_m")


@query(f"{B} SELECT dataset_id, frame_count, round(latitude, 8) AS lat, round(longitude, 8) AS lon FROM vxy")
def xy_roundtrip(spark, sf):
    lat, lon = geo.from_local_xy("x_m", "y_m", "lat0", "lon0")
    return sequence.with_local_xy(_valid(spark, sf)).select("dataset_id", "frame_count", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query(f"""{B}, p AS (SELECT *, lag(latitude) OVER {o.W} AS a, lag(longitude) OVER {o.W} AS b FROM valid)
SELECT dataset_id, frame_count, round({o.haversine('a', 'b', 'latitude', 'longitude')}, 6) AS step_m FROM p WHERE a IS NOT NULL""")
def haversine_step(spark, sf):
    w = sequence.along()
    t = _valid(spark, sf).withColumn("a", F.lag("latitude").over(w)).withColumn("b", F.lag("longitude").over(w)).where("a is not null")
    return t.select("dataset_id", "frame_count", F.round(geo.haversine("a", "b", "latitude", "longitude"), 6).alias("step_m"))


@query(f"{B} SELECT {rounded_sql('dataset_id frame_count', 'causal_heading')} FROM heads")
def heading_causal(spark, sf):
    return rounded(sequence.with_headings(sequence.with_local_xy(_valid(spark, sf))), "dataset_id frame_count", "causal_heading")


@query(f"{B} SELECT {rounded_sql('dataset_id frame_count', 'centred_heading')} FROM heads")
def heading_centered_bfill(spark, sf):
    return rounded(sequence.with_headings(sequence.with_local_xy(_valid(spark, sf))), "dataset_id frame_count", "centred_heading")


_yaw = "fmod(fmod(drone_yaw + 360.0::DOUBLE, 360.0::DOUBLE) + 360.0::DOUBLE, 360.0::DOUBLE)"
PROJ = f""", p1 AS (SELECT *, coalesce({_yaw}, causal_heading) AS heading_deg, coalesce({_yaw}, centred_heading) AS gt, coalesce(abs(gimbal_pitch), 60.0::DOUBLE) AS camera_angle_deg FROM heads),
p2 AS (SELECT *, CASE WHEN rel_alt <= 0 THEN 0.0::DOUBLE WHEN abs(tan({o.rad('camera_angle_deg')})) < 1e-9 THEN 'inf'::DOUBLE ELSE rel_alt / tan({o.rad('camera_angle_deg')}) END AS ground_distance_m FROM p1),
p3 AS (SELECT *, CASE WHEN ground_distance_m IS NULL THEN NULL WHEN gt IS NULL OR isinf(ground_distance_m) THEN 'nan'::DOUBLE ELSE x_m + ground_distance_m * sin({o.rad('gt')}) END AS ground_x_m,
  CASE WHEN ground_distance_m IS NULL THEN NULL WHEN gt IS NULL OR isinf(ground_distance_m) THEN 'nan'::DOUBLE ELSE y_m + ground_distance_m * cos({o.rad('gt')}) END AS ground_y_m FROM p2),
proj AS (SELECT *, {o.deg(f"ground_y_m / {o.R} + {o.rad('lat0')}")} AS ground_latitude, {o.deg(f"ground_x_m / (cos({o.rad('lat0')}) * {o.R}) + {o.rad('lon0')}")} AS ground_longitude,
  CASE WHEN drone_yaw IS NOT NULL THEN 'drone_yaw' ELSE 'trajectory' END AS heading_source, CASE WHEN gimbal_pitch IS NOT NULL THEN 'gimbal_pitch' ELSE 'fixed' END AS camera_angle_source FROM p3)"""


@query(f"{B}{PROJ} SELECT {rounded_sql('dataset_id frame_count heading_source camera_angle_deg camera_angle_source', 'heading_deg ground_distance_m ground_x_m ground_y_m', 'ground_latitude ground_longitude')} FROM proj")
def ground_projection(spark, sf):
    p = projection.ground_projection(_valid(spark, sf), CFG)
    return rounded(p, "dataset_id frame_count heading_source camera_angle_deg camera_angle_source", "heading_deg ground_distance_m ground_x_m ground_y_m", "ground_latitude ground_longitude")


_ext = ", ".join(f"round(coalesce(min(CASE WHEN isfinite({c}) THEN {c} END), 0), 6) AS {n}_min, round(coalesce(max(CASE WHEN isfinite({c}) THEN {c} END), 0), 6) AS {n}_max" for c, n in (("rel_alt", "rel_alt_m"), ("ground_distance_m", "ground_distance_m"), ("ground_x_m", "ground_x_m"), ("ground_y_m", "ground_y_m")))


@query(f"{B}{PROJ} SELECT dataset_id, count(*) AS row_count, {_ext} FROM proj GROUP BY dataset_id")
def projection_summary(spark, sf):
    s = projection.projection_summary(projection.ground_projection(_valid(spark, sf), CFG))
    return rounded(s, "dataset_id row_count", " ".join(c for c in s.columns if c not in ("dataset_id", "row_count")))


def _frames_points(spark, sf):
    t = _valid(spark, sf)
    return t.where("is_frame").select("dataset_id", "frame_count", "start_seconds"), t.where("not is_frame")


@query(f"""{B}, p AS (SELECT *, min(start_seconds) OVER (PARTITION BY dataset_id) AS t0, max(start_seconds) OVER (PARTITION BY dataset_id) AS t1 FROM valid WHERE NOT is_frame),
n AS (SELECT f.dataset_id, f.frame_count, f.start_seconds, p.start_seconds AS point_seconds, p.latitude, p.longitude,
  row_number() OVER (PARTITION BY f.dataset_id, f.frame_count ORDER BY abs(p.start_seconds - f.start_seconds), p.seq) AS k
  FROM valid f JOIN p ON f.is_frame AND f.dataset_id = p.dataset_id AND f.start_seconds BETWEEN t0 AND t1)
SELECT dataset_id, frame_count, start_seconds, point_seconds, latitude, longitude FROM n WHERE k = 1""")
def manifest_nearest(spark, sf):
    f, p = _frames_points(spark, sf)
    return sequence.nearest_in_time(f, p, ["latitude", "longitude"])


@query(f"{B} SELECT f.dataset_id, f.frame_count, p.frame_count AS projected, p.latitude, p.longitude FROM valid f JOIN valid p ON f.is_frame AND NOT p.is_frame AND f.dataset_id = p.dataset_id AND f.frame_count = p.frame_count + 1")
def manifest_exact(spark, sf):
    f, p = _frames_points(spark, sf)
    p = p.select("dataset_id", (F.col("frame_count") + 1).alias("frame_count"), F.col("frame_count").alias("projected"), "latitude", "longitude")
    return f.join(p, ["dataset_id", "frame_count"]).select("dataset_id", "frame_count", "projected", "latitude", "longitude")


@query(f"{B} SELECT dataset_id, k, arg_max(frame_count, seq) AS frame_count, max(seq) AS seq FROM tel GROUP BY dataset_id, k")
def dedupe_keep_last(spark, sf):
    return sequence.dedupe_keep_last(views.telemetry(spark, sf), "dataset_id", "k").select("dataset_id", "k", "frame_count", "seq")


@query(f"{B} SELECT dataset_id, k, min(seq) AS seq FROM tel GROUP BY dataset_id, k")
def ordered_unique(spark, sf):
    return sequence.ordered_unique(views.telemetry(spark, sf), "dataset_id", "k").select("dataset_id", "k", "seq")


@query(f"{B} SELECT 'a' AS dataset_id, CAST(0 AS INTEGER) AS src_ord, frame_count FROM tel WHERE k % 3 = 0 UNION ALL SELECT 'b', 1, frame_count FROM tel WHERE k % 4 = 0")
def union_manifests(spark, sf):
    t = views.telemetry(spark, sf).select("frame_count", "k")
    return sequence.union_tagged([("a", t.where("k % 3 = 0")), ("b", t.where("k % 4 = 0"))]).select("dataset_id", "src_ord", "frame_count")


# --- smoothing


@query(f"{B}, s AS (SELECT dataset_id, frame_count, {o.symmetric('bf_lat', 4)} AS lat, {o.symmetric('bf_lon', 4)} AS lon FROM ff) SELECT {rounded_sql('dataset_id frame_count', '', 'lat lon')} FROM s")
def smooth_symmetric(spark, sf):
    f = views.fixes(spark, sf).withColumn("a", smoothing.fill_batch("raw_lat")).withColumn("b", smoothing.fill_batch("raw_lon"))
    return rounded(f.withColumn("lat", smoothing.symmetric("a", 4)).withColumn("lon", smoothing.symmetric("b", 4)), "dataset_id frame_count", "", "lat lon")


LIVE = f"{B}, s AS (SELECT *, {o.causal('cf_lat', 4)} AS smoothed_lat, {o.causal('cf_lon', 4)} AS smoothed_lon FROM ff)"


@query(f"{LIVE} SELECT {rounded_sql('dataset_id frame_count', '', 'smoothed_lat smoothed_lon')} FROM s")
def smooth_causal(spark, sf):
    return rounded(smoothing.live_path(views.fixes(spark, sf)), "dataset_id frame_count", "", "smoothed_lat smoothed_lon")


_sweep = " UNION ALL ".join(f"SELECT dataset_id, {h} AS half_window, {o.haversine('a', 'b', 'gt_lat', 'gt_lon')} AS e FROM (SELECT dataset_id, gt_lat, gt_lon, {o.causal('bf_lat', h)} AS a, {o.causal('bf_lon', h)} AS b FROM ff)" for h in range(7))


@query(f"""{B}, e AS ({_sweep}), s AS (SELECT dataset_id, half_window, round(avg(e), 4) AS mean_m, round(list_sort(list(e))[1 + CAST(floor(count(*) * 0.5) AS BIGINT)], 4) AS median_m,
  round(list_sort(list(e))[1 + CAST(floor(count(*) * 0.9) AS BIGINT)], 4) AS p90_m, round(max(e), 4) AS max_m FROM e GROUP BY dataset_id, half_window)
SELECT dataset_id, half_window, mean_m, median_m, p90_m, max_m FROM s QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY mean_m, half_window) = 1""")
def smooth_sweep_best(spark, sf):
    f = views.fixes(spark, sf).withColumn("a", smoothing.fill_batch("raw_lat")).withColumn("b", smoothing.fill_batch("raw_lon"))
    return smoothing.best_window(smoothing.window_sweep(f, smoothing.causal, "a", "b"))


@query(f"{B} SELECT {rounded_sql('dataset_id frame_count', '', 'bf_lat bf_lon')} FROM ff")
def gapfill_batch(spark, sf):
    f = views.fixes(spark, sf)
    return rounded(f.withColumn("bf_lat", smoothing.fill_batch("raw_lat")).withColumn("bf_lon", smoothing.fill_batch("raw_lon")), "dataset_id frame_count", "", "bf_lat bf_lon")


@query(f"{B} SELECT {rounded_sql('dataset_id frame_count', '', 'cf_lat cf_lon')} FROM ff")
def gapfill_causal(spark, sf):
    f = views.fixes(spark, sf)
    return rounded(f.withColumn("cf_lat", smoothing.fill_causal("raw_lat")).withColumn("cf_lon", smoothing.fill_causal("raw_lon")), "dataset_id frame_count", "", "cf_lat cf_lon")


#: Rows of a block in the queries over blocks; flights of the tables are short.
BLOCK_ROWS = 1000


def _blocked(df: DataFrame) -> DataFrame:
    return scans.in_blocks(df, BLOCK_ROWS)


@query(f"{B} SELECT {rounded_sql('dataset_id frame_count', '', 'cf_lat cf_lon bf_lat bf_lon')} FROM ff")
def gapfill_blocked(spark, sf):
    f = scans.fill_forward(_blocked(views.fixes(spark, sf)), ["raw_lat", "raw_lon"], "_cf")
    f = scans.fill_backward(f, ["raw_lat", "raw_lon"], "_next")
    f = f.withColumn("cf_lat", F.col("raw_lat_cf")).withColumn("cf_lon", F.col("raw_lon_cf"))
    return rounded(f.withColumn("bf_lat", F.coalesce("raw_lat_cf", "raw_lat_next", F.lit(0.0))).withColumn("bf_lon", F.coalesce("raw_lon_cf", "raw_lon_next", F.lit(0.0))), "dataset_id frame_count", "", "cf_lat cf_lon bf_lat bf_lon")


@query(f"""{B}, s AS (SELECT *, sqrt(pow(x_m - lag(x_m) OVER w, 2) + pow(y_m - lag(y_m) OVER w, 2)) AS d FROM vxy WINDOW w AS {o.W})
SELECT dataset_id, frame_count, round(coalesce(d, 0), 6) AS step_m, round(sum(coalesce(d, 0)) OVER (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS path_so_far_m FROM s""")
def path_so_far(spark, sf):
    b = scans.with_neighbours(_blocked(sequence.with_local_xy(_valid(spark, sf))), 1, 0, BLOCK_ROWS)
    d = geo.length(F.col("x_m") - scans.neighbour("x_m", -1), F.col("y_m") - scans.neighbour("y_m", -1))
    b = b.withColumn("step_m", F.coalesce(d, F.lit(0.0))).where("own").drop("own")
    return rounded(scans.running_sum(b, ["step_m"]).withColumnRenamed("step_m_sum", "path_so_far_m"), "dataset_id frame_count", "step_m path_so_far_m")


@query(f"""{B}, b AS (SELECT f.*, (SELECT max(g.seq) FROM fx g WHERE g.dataset_id = f.dataset_id AND g.raw_lat IS NOT NULL AND g.seq <= f.seq) AS s0,
  (SELECT min(g.seq) FROM fx g WHERE g.dataset_id = f.dataset_id AND g.raw_lat IS NOT NULL AND g.seq >= f.seq) AS s1 FROM fx f),
i AS (SELECT b.dataset_id, b.frame_count, CASE WHEN b.raw_lat IS NOT NULL THEN 'FIX' ELSE 'INTERPOLATED' END AS method, b.seq, s0, s1, a.raw_lat AS la, a.raw_lon AS oa, c.raw_lat AS lc, c.raw_lon AS oc
  FROM b LEFT JOIN fx a ON a.dataset_id = b.dataset_id AND a.seq = s0 LEFT JOIN fx c ON c.dataset_id = b.dataset_id AND c.seq = s1)
SELECT dataset_id, frame_count, method,
  round(CASE WHEN s0 IS NULL THEN lc WHEN s1 IS NULL OR s0 = s1 THEN la ELSE la + (lc - la) * ((seq - s0) / CAST(s1 - s0 AS DOUBLE)) END, 8) AS est_latitude,
  round(CASE WHEN s0 IS NULL THEN oc WHEN s1 IS NULL OR s0 = s1 THEN oa ELSE oa + (oc - oa) * ((seq - s0) / CAST(s1 - s0 AS DOUBLE)) END, 8) AS est_longitude FROM i""")
def interpolate_gaps(spark, sf):
    return rounded(smoothing.interpolate(views.fixes(spark, sf), at="seq"), "dataset_id frame_count method", "", "est_latitude est_longitude")


@query(f"""{B}, l AS (SELECT *, last_value(CASE WHEN source = 'SAT' THEN start_seconds END IGNORE NULLS) OVER (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM fx)
SELECT dataset_id, frame_count, round(CASE WHEN source = 'SAT' THEN start_seconds - t END, 6) AS since_s FROM l""")
def since_last_fix(spark, sf):
    f = views.fixes(spark, sf)
    return f.select("dataset_id", "frame_count", F.round(sequence.since_last(F.col("source") == "SAT"), 6).alias("since_s"))


@query(f"""{B}, a AS (SELECT dataset_id, frame_count AS frame_a, lead(frame_count) OVER {o.W} AS frame_b, start_seconds, rel_alt, k FROM tel WHERE rel_alt IS NOT NULL),
b AS (SELECT *, (rel_alt + lead(rel_alt) OVER w) / 2.0::DOUBLE AS alt, lead(start_seconds) OVER w - start_seconds AS dt FROM a WINDOW w AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_a)),
c AS (SELECT *, CASE WHEN alt <= 0 THEN 0.0::DOUBLE ELSE alt / {o.num(math.cos(math.radians(30.0)))} / {o.num((1920 / 2) / math.tan(math.radians(82.1 / 2)))} END AS gsd, CASE WHEN dt > 0 THEN dt ELSE 1.0::DOUBLE END AS d FROM b WHERE frame_b IS NOT NULL),
e AS (SELECT *, -(k % 7 - 3.0::DOUBLE) * gsd AS ex, -(k % 5 - 2.0::DOUBLE) * gsd AS ey FROM c)
SELECT dataset_id, frame_a, frame_b, round(ex, 6) + 0.0::DOUBLE AS dr_dx_m, round(ey, 6) + 0.0::DOUBLE AS dr_dy_m, round({o.length('ex', 'ey')} / d, 6) + 0.0::DOUBLE AS speed_m_s,
  round(sum(ex) OVER w, 6) + 0.0::DOUBLE AS cum_x_m, round(sum(ey) OVER w, 6) + 0.0::DOUBLE AS cum_y_m FROM e WINDOW w AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def dead_reckoning(spark, sf):
    t = views.telemetry(spark, sf).where("rel_alt is not null").withColumnRenamed("rel_alt", "rel_alt_m").withColumn("dx_px", F.col("k") % 7 - 3.0).withColumn("dy_px", F.col("k") % 5 - 2.0)
    return rounded(raster.dead_reckoning(t), "dataset_id frame_a frame_b", "dr_dx_m dr_dy_m speed_m_s cum_x_m cum_y_m")


@query(f"{B}, d AS (SELECT dataset_id, {o.length('x_m - lag(x_m) OVER w', 'y_m - lag(y_m) OVER w')} AS d FROM vxy WINDOW w AS {o.W}) SELECT dataset_id, round(coalesce(sum(d), 0), 6) AS path_m FROM d GROUP BY dataset_id")
def path_length(spark, sf):
    return rounded(sequence.path_length(sequence.with_local_xy(_valid(spark, sf))), "dataset_id", "path_m")


@query(f"""{B}, t AS (SELECT dataset_id, gt_lat, gt_lon, row_number() OVER {o.W} AS i FROM fx), e AS (SELECT dataset_id, raw_lat, raw_lon, row_number() OVER {o.W} AS i FROM fx WHERE raw_lat IS NOT NULL)
SELECT dataset_id, i, round({o.haversine('gt_lat', 'gt_lon', 'raw_lat', 'raw_lon')}, 6) AS error_m FROM t JOIN e USING (dataset_id, i)""")
def positional_errors(spark, sf):
    f = views.fixes(spark, sf)
    numbered = lambda d: d.withColumn("i", F.row_number().over(sequence.along()).cast("long"))
    t = numbered(f).select("dataset_id", "i", "gt_lat", "gt_lon")
    e = numbered(f.where("raw_lat is not null")).select("dataset_id", "i", "raw_lat", "raw_lon")
    return t.join(e, ["dataset_id", "i"]).select("dataset_id", "i", F.round(geo.haversine("gt_lat", "gt_lon", "raw_lat", "raw_lon"), 6).alias("error_m"))


# --- fusion


def _fused(spark, sf) -> DataFrame:
    f = views.fixes(spark, sf)
    keys = ["dataset_id", "frame_count"]
    decision = f.where("k % 3 = 0").select(*keys, F.when(F.col("k") % 2 == 0, "FIX").otherwise("NO_FIX").alias("decision"))
    vpr = f.where("k % 7 <> 0").select(*keys, (F.col("gt_lat") + (F.col("k") - 50) * 1e-6).alias("vpr_lat"), F.col("gt_lon").alias("vpr_lon"))
    sat = f.where("source = 'SAT'").select(*keys, F.when(F.col("k") % 4 == 0, "few_matches").otherwise("ok").alias("sat_status"), F.col("raw_lat").alias("sat_lat"), F.col("raw_lon").alias("sat_lon"))
    return fusion.fuse(f.select(*keys, "gt_lat", "gt_lon"), decision, vpr, sat, keys)


FUSED = f"""{B}, u0 AS (SELECT dataset_id, frame_count, gt_lat, gt_lon, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'FIX' ELSE 'NO_FIX' END END AS decision,
  CASE WHEN k % 7 <> 0 THEN gt_lat + (k - 50) * 1e-6 END AS vpr_lat, CASE WHEN k % 7 <> 0 THEN gt_lon END AS vpr_lon, source = 'SAT' AND k % 4 <> 0 AS ok, raw_lat, raw_lon FROM fx),
u1 AS (SELECT *, CASE WHEN decision = 'FIX' THEN 'VPR_FIX' WHEN ok THEN 'SAT_FIX' ELSE 'VPR_FALLBACK' END AS final_status FROM u0),
u2 AS (SELECT *, CASE WHEN final_status = 'SAT_FIX' THEN raw_lat ELSE vpr_lat END AS la, CASE WHEN final_status = 'SAT_FIX' THEN raw_lon ELSE vpr_lon END AS lo FROM u1),
u AS (SELECT dataset_id, frame_count, final_status, round(la, 7) AS final_lat, round(lo, 7) AS final_lon, round({o.haversine('gt_lat', 'gt_lon', 'la', 'lo')}, 2) AS final_error_m FROM u2)"""


@query(f"{FUSED} SELECT * FROM u")
def fusion_offline(spark, sf):
    return _fused(spark, sf).select("dataset_id", "frame_count", "final_status", "final_lat", "final_lon", "final_error_m")


_pct = ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (final_error_m <= {t}) / count(final_error_m), 1) AS pct_{t}m" for t in (5, 10, 15, 20))


@query(f"{FUSED} SELECT coalesce(final_status, 'ALL') AS final_status, count(*) AS count, round(quantile_cont(final_error_m, 0.5), 2) AS median, round(avg(final_error_m), 2) AS mean, min(final_error_m) AS min, max(final_error_m) AS max, {_pct} FROM u GROUP BY GROUPING SETS ((final_status), ())")
def fusion_summary_grouping(spark, sf):
    return fusion.by_status_and_overall(_fused(spark, sf), "final_status", "final_error_m")


@query(f"""{B}, s AS (SELECT dataset_id, frame_count, k, CASE WHEN seq = 1 THEN 'no_position_yet' WHEN rel_alt IS NULL OR rel_alt < 20 THEN 'low_alt' WHEN k % 11 = 0 THEN 'no_heading_yet' WHEN k % 13 = 0 THEN 'no_image'
  WHEN k % 40 < 8 THEN 'few_matches' WHEN k % 23 < 8 THEN 'ransac_fail' ELSE 'ok' END AS sat_status FROM fx)
SELECT dataset_id, frame_count, sat_status, CASE WHEN sat_status = 'ok' THEN 'SAT' WHEN k * 3 >= 100 AND k % 10 >= 7 THEN 'VPR_FALLBACK' ELSE 'NO_FIX' END AS source FROM s""")
def cascade_live(spark, sf):
    f = views.fixes(spark, sf)
    k = F.col("k")
    f = f.withColumn("have_fix", F.col("seq") > 1).withColumn("heading_deg", F.when(k % 11 != 0, 0.0)).withColumn("has_image", k % 13 != 0).withColumn("matches", k % 40).withColumn("inliers", k % 23)
    f = f.withColumn("sat_status", fusion.satellite_status()).withColumn("key", F.struct("dataset_id", "frame_count"))
    back = lambda rest: rest.select("key", (k * 3).alias("lg_inlier_count"), (k % 10 / 10).alias("lg_inlier_ratio"))
    return fusion.cascade(f, back, "key").select("key.*", "sat_status", "source")


@query(f"{FUSED}, n AS (SELECT count(*) AS f FROM u) SELECT CAST(t AS INTEGER) AS threshold_m, (SELECT count(*) FROM u WHERE final_error_m <= t) AS hits, round(100.0::DOUBLE * (SELECT count(*) FROM u WHERE final_error_m <= t) / f, 1) AS percent FROM n, unnest([5, 10, 15, 20, 30]) AS x(t)")
def threshold_hits(spark, sf):
    return fusion.threshold_hits(_fused(spark, sf), "final_error_m")


@query(f"""{B}, s AS (SELECT rel_alt AS s, k % 3 = 0 AS t FROM tel WHERE rel_alt IS NOT NULL)
SELECT round(avg(s), 6) AS mean_s, round(quantile_cont(s, 0.5), 6) AS median_s, round(max(s), 6) AS max_s, round(avg(s) FILTER (NOT t), 6) AS satellite_only_mean_s, round(avg(s) FILTER (t), 6) AS fallback_mean_s, round(1 / avg(s), 6) AS fps FROM s""")
def timing_summary(spark, sf):
    t = views.telemetry(spark, sf).where("rel_alt is not null").withColumn("triggered", F.col("k") % 3 == 0)
    return rounded(fusion.timing_summary(t, "rel_alt", "triggered"), "", "mean_s median_s max_s satellite_only_mean_s fallback_mean_s fps")


# --- reports


@query(f"{FUSED} SELECT dataset_id, frame_count, final_error_m FROM u WHERE final_error_m IS NOT NULL ORDER BY final_error_m DESC, frame_count LIMIT 15")
def worst_errors(spark, sf):
    return sinks.worst(_fused(spark, sf).where("final_error_m is not null"), "final_error_m", 15, "frame_count").select("dataset_id", "frame_count", "final_error_m")


@query(f"{B} SELECT dataset_id, frame_count, printf('%.8f,%.8f,%.2f', longitude, latitude, 0.0::DOUBLE) AS coord FROM valid")
def kml_coords(spark, sf):
    t = views.telemetry(spark, sf).where(sinks.valid_coord("latitude", "longitude"))
    return t.select("dataset_id", "frame_count", sinks.kml_coord("latitude", "longitude").alias("coord"))


@query(f"{B} SELECT dataset_id, string_agg(printf('%.8f,%.8f,%.2f', longitude, latitude, 0.0::DOUBLE), ' ' ORDER BY seq) AS coordinates FROM valid GROUP BY dataset_id")
def kml_linestring(spark, sf):
    return sinks.line_string(views.telemetry(spark, sf), "dataset_id", "latitude", "longitude", "seq")


@query(f"""{B}, b AS (SELECT *, min(x_m) OVER p AS x0, max(x_m) OVER p AS x1, min(y_m) OVER p AS y0, max(y_m) OVER p AS y1 FROM vxy WINDOW p AS (PARTITION BY dataset_id)),
s AS (SELECT *, least(920.0::DOUBLE / greatest(x1 - x0, 1.0::DOUBLE), 620.0::DOUBLE / greatest(y1 - y0, 1.0::DOUBLE)) AS scale FROM b)
SELECT dataset_id, frame_count, round(40.0::DOUBLE + (x_m - x0) * scale, 6) AS svg_x, round(660.0::DOUBLE - (y_m - y0) * scale, 6) AS svg_y FROM s""")
def svg_fit(spark, sf):
    return rounded(sinks.svg_fit(sequence.with_local_xy(_valid(spark, sf)), "x_m", "y_m"), "dataset_id frame_count", "svg_x svg_y")


# --- tiles and camera


@query(f"{B} SELECT dataset_id, frame_count, {o.tile_x('longitude')} AS tile_x, {o.tile_y('latitude')} AS tile_y FROM valid")
def tile_index(spark, sf):
    return raster.with_tile(_valid(spark, sf), "latitude", "longitude").select("dataset_id", "frame_count", "tile_x", "tile_y")


TILES = f"{B}, t AS (SELECT DISTINCT {o.tile_x('longitude')} AS tile_x, {o.tile_y('latitude')} AS tile_y FROM valid)"


def _tiles(spark, sf) -> DataFrame:
    return raster.with_tile(_valid(spark, sf), "latitude", "longitude").select("tile_x", "tile_y").distinct()


@query(f"{TILES} SELECT tile_x, tile_y, round({o.north('tile_y')}, 8) AS north, round({o.north('tile_y + 1')}, 8) AS south, round({o.west('tile_x')}, 8) AS west, round({o.west('tile_x + 1')}, 8) AS east FROM t")
def tile_bbox(spark, sf):
    return rounded(raster.with_bbox(_tiles(spark, sf)), "tile_x tile_y", "", "north south west east")


@query(f"{TILES} SELECT tile_x, tile_y, tile_x + dx AS near_x, tile_y + dy AS near_y FROM t, unnest([-1, 0, 1]) AS a(dx), unnest([-1, 0, 1]) AS b(dy)")
def tile_neighbours(spark, sf):
    return raster.neighbours(_tiles(spark, sf)).select("tile_x", "tile_y", "near_x", "near_y")


_dlat, _dlon = o.num(800.0 / geo.METRES_PER_DEGREE), f"(800.0::DOUBLE * (1.0::DOUBLE / ({geo.METRES_PER_DEGREE!r}::DOUBLE * cos({o.rad('la')}))))"


@query(f"""{B}, c AS (SELECT dataset_id, avg(latitude) AS la, avg(longitude) AS lo FROM valid GROUP BY dataset_id),
r AS (SELECT dataset_id, {o.tile_x(f'lo - {_dlon}')} AS x0, {o.tile_x(f'lo + {_dlon}')} AS x1, {o.tile_y(f'la + {_dlat}')} AS y0, {o.tile_y(f'la - {_dlat}')} AS y1 FROM c), xs AS (SELECT *, unnest(range(x0, x1 + 1)) AS tile_x FROM r)
SELECT dataset_id, tile_x, unnest(range(y0, y1 + 1)) AS tile_y FROM xs""")
def region_cover(spark, sf):
    c = _valid(spark, sf).groupBy("dataset_id").agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"))
    return raster.region_cover(c, "la", "lo", 800.0).select("dataset_id", "tile_x", "tile_y")


@query(f"""{B}, m AS (SELECT dataset_id, frame_count, latitude, longitude, {o.north(o.tile_y('latitude') + ' - 1')} AS n, {o.north(o.tile_y('latitude') + ' + 2')} AS s, {o.west(o.tile_x('longitude') + ' - 1')} AS w, {o.west(o.tile_x('longitude') + ' + 2')} AS e FROM valid),
p AS (SELECT *, (longitude - w) / (e - w) * 768 AS px, (n - latitude) / (n - s) * 768 AS py FROM m)
SELECT dataset_id, frame_count, round(px, 4) AS px, round(py, 4) AS py, round(n - py / 768 * (n - s), 8) AS lat, round(w + px / 768 * (e - w), 8) AS lon FROM p""")
def pixel_latlon(spark, sf):
    m = raster.mosaic_extent(_valid(spark, sf), "latitude", "longitude")
    px, py = geo.tile_pixel("latitude", "longitude", "north", "south", "west", "east", 768)
    m = m.withColumn("px", px).withColumn("py", py)
    lat, lon = geo.pixel_position("px", "py", "north", "south", "west", "east", 768)
    return m.select("dataset_id", "frame_count", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


def _cameras(spark, sf) -> DataFrame:
    t = _valid(spark, sf).where("rel_alt > 0")
    return t.select("dataset_id", "frame_count", F.col("rel_alt").alias("altitude"), (F.col("k") % 60 + 20.0).alias("angle"), (F.col("k") * 3.0).alias("heading"))


_cam = f"{B}, c AS (SELECT dataset_id, frame_count, rel_alt AS altitude, k % 60 + 20.0::DOUBLE AS angle, k * 3.0::DOUBLE AS heading FROM valid WHERE rel_alt > 0), a AS (SELECT *, sin({o.rad('angle')}) AS st, cos({o.rad('angle')}) AS ct, sin({o.rad('heading')}) AS sp, cos({o.rad('heading')}) AS cp, tan({o.rad('angle')}) AS tg FROM c)"
_m = o.camera_matrix(1920, 1080)


@query(f"{_cam} SELECT dataset_id, frame_count, round(cp, 6) AS r00, round(-st * sp, 6) AS r01, round(ct * sp, 6) AS r02, round(-sp, 6) AS r10, round(-st * cp, 6) AS r11, round(ct * cp, 6) AS r12, round(-ct, 6) AS r21, round(-st, 6) AS r22 FROM a")
def camera_rotation(spark, sf):
    r = geo.camera_rotation("angle", "heading")
    cells = [F.round(r[i][j], 6).alias(f"r{i}{j}") for i in range(3) for j in range(3) if (i, j) != (2, 0)]
    return _cameras(spark, sf).select("dataset_id", "frame_count", *cells)


GRID = 512
_ahead = "kz > 1e-3::DOUBLE"


@query(f"""{_cam}, g AS (SELECT a.*, (j - {GRID / 2}::DOUBLE) * 0.5::DOUBLE + altitude / tg * sp AS gx, ({GRID / 2}::DOUBLE - i) * 0.5::DOUBLE + altitude / tg * cp AS gy, -altitude AS gz
  FROM a, unnest(range(0, {GRID})) AS x(i), unnest(range(0, {GRID})) AS y(j)),
k AS (SELECT dataset_id, frame_count, cp * gx - sp * gy AS kx, -st * sp * gx - st * cp * gy - ct * gz AS ky, ct * sp * gx + ct * cp * gy - st * gz AS kz FROM g),
m AS (SELECT dataset_id, frame_count, {_ahead} AS ahead, CASE WHEN {_ahead} THEN {o.num(_m['fx'])} * kx / kz + {o.num(_m['cx'])} ELSE -1 END AS mx, CASE WHEN {_ahead} THEN {o.num(_m['fy'])} * ky / kz + {o.num(_m['cy'])} ELSE -1 END AS my FROM k),
n AS (SELECT *, ahead AND mx >= 0 AND mx < 1920 AND my >= 0 AND my < 1080 AS inside FROM m)
SELECT dataset_id, frame_count, CAST(count(*) FILTER (ahead) AS BIGINT) AS n_ahead, CAST(count(*) FILTER (inside) AS BIGINT) AS n_inside, round(avg(mx) FILTER (inside), 4) AS mean_x, round(avg(my) FILTER (inside), 4) AS mean_y FROM n GROUP BY dataset_id, frame_count""")
def ipm_grid(spark, sf):
    keys = ["dataset_id", "frame_count"]
    c = raster.camera_coverage(_cameras(spark, sf), keys)
    return c.select(*keys, "n_ahead", "n_inside", F.round("mean_x", 4).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"))


_hv = o.num(o.vertical_fov(82.0, 1920, 1080) / 2)


@query(f"""{_cam} SELECT dataset_id, frame_count, round(2.0::DOUBLE * (altitude / tg) * {o.num(math.tan(math.radians(82.0) / 2))}, 4) AS width_m,
  round(least(CASE WHEN {o.rad('angle')} - {_hv} > 0 THEN altitude / tan({o.rad('angle')} - {_hv}) ELSE 'inf'::DOUBLE END, 2.0::DOUBLE * (altitude / tg)) - CASE WHEN {o.rad('angle')} + {_hv} < {o.num(math.pi / 2)} THEN altitude / tan({o.rad('angle')} + {_hv}) ELSE 0 END, 4) AS depth_m FROM a""")
def ipm_footprint(spark, sf):
    w, d = geo.footprint("altitude", "angle")
    return _cameras(spark, sf).select("dataset_id", "frame_count", F.round(w, 4).alias("width_m"), F.round(d, 4).alias("depth_m"))


@query(f"""{_cam}, h AS (SELECT *, 256.0::DOUBLE * ct + 256.0::DOUBLE * st + 5 AS x, 256.0::DOUBLE * -st + 256.0::DOUBLE * ct - 3 AS y, 256.0::DOUBLE * 1e-4 + 256.0::DOUBLE * 2e-4 + 1 AS w FROM a)
SELECT dataset_id, frame_count, round(x / w, 6) AS px, round(y / w, 6) AS py FROM h""")
def homography_point(spark, sf):
    th = F.radians("angle")
    h = [F.cos(th), F.sin(th), 5.0, -F.sin(th), F.cos(th), -3.0, 1e-4, 2e-4, 1.0]
    x, y = geo.homography_point(h, 256.0, 256.0)
    return _cameras(spark, sf).select("dataset_id", "frame_count", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


_kml_pt = lambda lat, lon: f"printf('%.8f,%.8f,%.2f', {lon}, {lat}, 0.0::DOUBLE)"
_kml_kinds = "CASE final_status WHEN 'VPR_FIX' THEN 'fix' WHEN 'SAT_FIX' THEN 'satellite' ELSE 'fallback' END"
_fine = "final_lat IS NOT NULL AND final_lon IS NOT NULL"


@query(f"""{FUSED}, d AS (SELECT u.*, fx.gt_lat, fx.gt_lon, fx.start_seconds AS time_s FROM u JOIN fx USING (frame_count)),
paths AS (SELECT 0 AS item, frame_count, {_kml_pt('gt_lat', 'gt_lon')} AS c FROM d
  UNION ALL SELECT CASE final_status WHEN 'VPR_FIX' THEN 1 WHEN 'SAT_FIX' THEN 2 ELSE 3 END, frame_count, {_kml_pt('final_lat', 'final_lon')} FROM d WHERE {_fine}),
w AS (SELECT * FROM d WHERE {_fine} ORDER BY final_error_m DESC, frame_count LIMIT 15),
l AS (SELECT 1 AS section, item, 1 AS part, row_number() OVER (PARTITION BY item ORDER BY frame_count) - 1 AS n, c AS line FROM paths
  UNION ALL SELECT DISTINCT 1, item, 0, 0, '<Placemark><name>' || CASE item WHEN 0 THEN 'Ground truth' WHEN 1 THEN 'VPR_FIX' WHEN 2 THEN 'SAT_FIX' ELSE 'VPR_FALLBACK' END || ' path</name><styleUrl>#' || CASE item WHEN 0 THEN 'truth' WHEN 1 THEN 'fix' WHEN 2 THEN 'satellite' ELSE 'fallback' END
    || '-path</styleUrl><LineString><tessellate>1</tessellate><altitudeMode>clampToGround</altitudeMode><coordinates>' FROM paths
  UNION ALL SELECT DISTINCT 1, item, 2, 0, '</coordinates></LineString></Placemark>' FROM paths
  UNION ALL SELECT 2, frame_count, 1, 0, '<Placemark><name>' || final_status || printf(' #%d (%.1f m)', frame_count, final_error_m) || '</name><description>' || printf('Frame: %d  t=%.6fs', frame_count, time_s) || '&#10;Status: ' || final_status || printf('&#10;Error: %.1f m&#10;GT: %.8f, %.8f&#10;Est: %.8f, %.8f', final_error_m, gt_lat, gt_lon, final_lat, final_lon)
    || '</description><styleUrl>#' || {_kml_kinds} || '-point</styleUrl><Point><coordinates>' || {_kml_pt('final_lat', 'final_lon')} || '</coordinates></Point></Placemark>' FROM d WHERE {_fine}
  UNION ALL SELECT 3, frame_count, 1, 0, '<Placemark><styleUrl>#error-line</styleUrl><LineString><tessellate>1</tessellate><coordinates>' || {_kml_pt('gt_lat', 'gt_lon')} || ' ' || {_kml_pt('final_lat', 'final_lon')} || '</coordinates></LineString></Placemark>' FROM w)
SELECT CAST(section AS INTEGER) AS section, CAST(item AS BIGINT) AS item, CAST(part AS INTEGER) AS part, CAST(n AS BIGINT) AS n, line FROM l""")
def hybrid_kml(spark, sf):
    times = views.fixes(spark, sf).select("frame_count", "gt_lat", "gt_lon", F.col("start_seconds").alias("time_s"))
    fused = _fused(spark, sf).drop("gt_lat", "gt_lon").join(times, "frame_count")
    lines = kml.hybrid_document(fused)
    # places of rows are increasing, not dense; they are numbered here to be compared
    return scans.numbered(lines, ["section", "item", "part"], ["seq"], "n").select("section", "item", "part", "n", "line")


# --- inliers of a given matrix: each eight rows of a flight are the matches of a pair


@query(f"""{B}, p AS (SELECT dataset_id, (seq - 1) // 8 AS pair, k, frame_count % 500 + 0.0::DOUBLE AS x0, k * 3.0::DOUBLE AS y0 FROM tel),
h AS (SELECT dataset_id, pair, count(*) AS n, min(k) * 1e-5::DOUBLE AS g FROM p GROUP BY ALL),
d AS (SELECT p.dataset_id, p.pair, n, (x0 + 0.1::DOUBLE * y0 + 3) / (g * x0 + 1) - (x0 + 0.1::DOUBLE * y0 + 3 + k % 9 - 4) AS dx, (y0 - 2) / (g * x0 + 1) - (y0 - 2 + k % 5 - 2) AS dy FROM p JOIN h ON p.dataset_id = h.dataset_id AND p.pair = h.pair)
SELECT dataset_id, pair, CAST(n AS INTEGER) AS n_matches, CAST(CASE WHEN n < 4 THEN 0 ELSE count(*) FILTER (sqrt(dx * dx + dy * dy) <= 4.0::DOUBLE) END AS INTEGER) AS inliers,
  round(CASE WHEN n < 4 THEN 0 ELSE count(*) FILTER (sqrt(dx * dx + dy * dy) <= 4.0::DOUBLE) END / CAST(n AS DOUBLE), 6) AS inlier_ratio FROM d GROUP BY dataset_id, pair, n""")
def homography_inliers(spark, sf):
    k, x, y = F.col("k"), F.col("frame_count") % 500 + 0.0, F.col("k") * 3.0
    p = views.telemetry(spark, sf).select("dataset_id", F.floor((F.col("seq") - 1) / 8).alias("pair"), "k", F.struct(x.alias("x0"), y.alias("y0"), (x + 0.1 * y + 3 + k % 9 - 4).alias("x1"), (y - 2 + k % 5 - 2).alias("y1")).alias("p"))
    g = p.groupBy("dataset_id", "pair").agg(F.collect_list("p").alias("points"), (F.min("k") * 1e-5).alias("g"))  # at most eight
    g = g.withColumn("h", F.array(*[F.lit(v) for v in (1.0, 0.1, 3.0, 0.0, 1.0, -2.0)], F.col("g"), F.lit(0.0), F.lit(1.0)))
    return raster.with_inliers(g, "points", "h", 4.0).select("dataset_id", "pair", "n_matches", "inliers", F.round("inlier_ratio", 6).alias("inlier_ratio"))


@query(f"""{B}, i AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY start_seconds, frame_count) - 1 AS idx FROM fx),
s AS (SELECT *, min(CASE WHEN raw_lat IS NOT NULL THEN idx END) OVER (PARTITION BY dataset_id) AS start FROM i),
m AS (
  SELECT dataset_id, idx, 'truth begins' AS label, 'truth-start' AS style, gt_lat AS lat, gt_lon AS lon FROM s WHERE idx = 0
  UNION ALL SELECT dataset_id, idx, CASE WHEN idx > 0 THEN 'estimate begins at row ' || idx ELSE 'estimate begins' END, 'estimate-start', raw_lat, raw_lon FROM s WHERE idx = start
  UNION ALL SELECT dataset_id, idx, 'truth +' || idx || ' s', 'truth-dot', gt_lat, gt_lon FROM s WHERE idx < 30 AND idx % 5 = 0
  UNION ALL SELECT dataset_id, idx, 'estimate +' || idx || ' s', 'estimate-dot', raw_lat, raw_lon FROM s WHERE idx < 30 AND idx % 5 = 0 AND raw_lat IS NOT NULL)
SELECT dataset_id, idx, style, '<Placemark><name>' || label || '</name><styleUrl>#' || style || '</styleUrl><Point><coordinates>' || printf('%.8f,%.8f,%.2f', lon, lat, 0.0::DOUBLE) || '</coordinates></Point></Placemark>' AS xml FROM m""")
def live_placemarks(spark, sf):
    f = views.fixes(spark, sf).withColumnRenamed("raw_lat", "est_lat").withColumnRenamed("raw_lon", "est_lon")
    return sinks.point_placemarks(sinks.live_points(f), "label", "lat", "lon", "style").select("dataset_id", "idx", "style", "xml")


@query(f"{B}, i AS (SELECT dataset_id, frame_count, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY start_seconds, frame_count) - 1 AS INTEGER) AS idx FROM tel) SELECT * FROM i WHERE idx < 30 AND idx % 5 = 0")
def early_rows(spark, sf):
    return sequence.early_rows(views.telemetry(spark, sf)).select("dataset_id", "frame_count", "idx")


@query(f"{B} SELECT f.dataset_id, f.frame_count, round(coalesce(t.start_seconds, CAST(f.seq AS DOUBLE)), 6) AS time_s FROM fx f LEFT JOIN (SELECT * FROM tel WHERE is_frame) t USING (dataset_id, frame_count)")
def query_times(spark, sf):
    times = views.telemetry(spark, sf).where("is_frame")
    return rounded(sequence.query_times(views.fixes(spark, sf), times), "dataset_id frame_count", "time_s")


@query(f"""{B} SELECT dataset_id, frame_count, CASE WHEN k % 11 = 0 THEN 'no_heading_yet' WHEN rel_alt IS NULL OR rel_alt < 20 THEN 'low_alt' WHEN k % 13 = 0 THEN 'no_image'
  WHEN k % 17 = 0 THEN 'match_error' WHEN k % 40 < 8 THEN 'few_matches' WHEN k % 23 < 8 THEN 'ransac_fail' ELSE 'ok' END AS status FROM fx""")
def evaluation_status(spark, sf):
    k = F.col("k")
    f = views.fixes(spark, sf).withColumn("heading_deg", F.when(k % 11 != 0, 0.0)).withColumn("has_image", k % 13 != 0).withColumn("matches", F.when(k % 17 != 0, k % 40)).withColumn("inliers", k % 23)
    return f.select("dataset_id", "frame_count", fusion.evaluation_status().alias("status"))


@query(f"{B}, m AS (SELECT dataset_id, seq // 8 AS pair, k % 29 - 14 AS dx, k % 31 - 15 AS dy FROM tel) SELECT dataset_id, pair, CASE WHEN count(*) < 4 THEN 0.0::DOUBLE ELSE round(median(dx), 6) END AS dx_px, CASE WHEN count(*) < 4 THEN 0.0::DOUBLE ELSE round(median(dy), 6) END AS dy_px, count(*) AS n_matches FROM m GROUP BY ALL")
def median_shift(spark, sf):
    t = views.telemetry(spark, sf).select("dataset_id", F.floor(F.col("seq") / 8).alias("pair"), (F.col("k") % 29 - 14).alias("dx"), (F.col("k") % 31 - 15).alias("dy"))
    return rounded(raster.median_shift(t, ["dataset_id", "pair"]), "dataset_id pair n_matches", "dx_px dy_px")


@query(f"{B}, w AS (SELECT dataset_id, frame_count, 200 + k * 7 AS w, 150 + k * 5 AS h FROM tel), s AS (SELECT *, least(1.0::DOUBLE, 518.0::DOUBLE / greatest(w, h)) AS z FROM w) SELECT dataset_id, frame_count, CAST(floor(round(w * z) / 14) * 14 AS BIGINT) AS width, CAST(floor(round(h * z) / 14) * 14 AS BIGINT) AS height FROM s")
def patch_sizes(spark, sf):
    t = views.telemetry(spark, sf).withColumn("w", 200 + F.col("k") * 7).withColumn("h", 150 + F.col("k") * 5)
    w, h = raster.patch_aligned("w", "h")
    return t.select("dataset_id", "frame_count", w.alias("width"), h.alias("height"))


# --- costs, offsets, names and scales


@query(f"""{B}, s AS (SELECT *, x_m - lag(x_m) OVER w AS bx, y_m - lag(y_m) OVER w AS b_y, lag(x_m) OVER w - lag(x_m, 2) OVER w AS ax, lag(y_m) OVER w - lag(y_m, 2) OVER w AS a_y FROM vxy WINDOW w AS {o.W}),
t AS (SELECT *, {o.length('ax', 'a_y')} AS a, {o.length('bx', 'b_y')} AS b FROM s WHERE ax IS NOT NULL)
SELECT dataset_id, frame_count, round(1.0::DOUBLE * pow({o.length('bx - ax', 'b_y - a_y')} / 20.0::DOUBLE, 2), 6) + 0.0::DOUBLE AS acceleration_cost,
  round(CASE WHEN a < 3 OR b < 3 THEN 0 ELSE 2.0::DOUBLE * pow({o.deg('acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (ax * bx + a_y * b_y) / (a * b))))')} / 45.0::DOUBLE, 2) END, 5) + 0.0::DOUBLE AS direction_cost FROM t""")
def turn_costs(spark, sf):
    w = sequence.along()
    t = sequence.with_local_xy(_valid(spark, sf))
    for c, v in (("bx", "x_m"), ("b_y", "y_m")):
        t = t.withColumn(c, F.col(v) - F.lag(v).over(w)).withColumn(c.replace("b", "a", 1), F.lag(v).over(w) - F.lag(v, 2).over(w))
    t = t.where("ax is not null")
    a = geo.acceleration_cost(F.col("bx") - F.col("ax"), F.col("b_y") - F.col("a_y"))
    d = geo.direction_cost(F.col("ax"), F.col("a_y"), F.col("bx"), F.col("b_y"), weight=2.0)
    return t.select("dataset_id", "frame_count", (F.round(a, 6) + 0.0).alias("acceleration_cost"), (F.round(d, 5) + 0.0).alias("direction_cost"))


@query(f"{B} SELECT dataset_id, frame_count, round(latitude + k * 3.0::DOUBLE / {geo.METRES_PER_DEGREE!r}::DOUBLE, 8) AS lat, round(longitude + k * 2.0::DOUBLE / ({geo.METRES_PER_DEGREE!r}::DOUBLE * cos({o.rad('latitude')})), 8) AS lon FROM valid")
def search_centres(spark, sf):
    lat, lon = geo.offset_degrees("latitude", "longitude", F.col("k") * 3.0, F.col("k") * 2.0)
    return _valid(spark, sf).select("dataset_id", "frame_count", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query(f"{B} SELECT frame_count, CAST(k || '' || frame_count AS BIGINT) AS frame_number, round(5.0::DOUBLE + (frame_count - 1) / 30.0::DOUBLE, 6) + 0.0::DOUBLE AS seconds FROM tel")
def frame_numbers(spark, sf):
    stem = F.concat(F.lit("cam"), F.col("k").cast("string"), F.lit("_f"), F.col("frame_count").cast("string"))
    t = views.telemetry(spark, sf).select("frame_count", readers.frame_number(stem).alias("frame_number"), readers.frame_seconds(F.col("frame_count"), 30.0, 5.0).alias("seconds"))
    return rounded(t, "frame_count frame_number", "seconds")


@query(f"{B} SELECT frame_count, CASE WHEN k % 3 = 0 THEN 't' || k WHEN k % 3 = 1 THEN 'g' || k END AS \"timestamp\", round(CASE WHEN k % 2 = 0 THEN start_seconds WHEN k % 5 <> 0 THEN k + 0.5::DOUBLE ELSE 0 END, 6) AS start_seconds FROM tel")
def telemetry_aliases(spark, sf):
    k = F.col("k")
    t = views.telemetry(spark, sf).withColumn("timestamp", F.when(k % 3 == 0, F.concat(F.lit("t"), k.cast("string"))).otherwise("")).withColumn("gps_datetime", F.when(k % 3 == 1, F.concat(F.lit("g"), k.cast("string"))))
    t = t.withColumn("start_seconds", F.when(k % 2 == 0, F.col("start_seconds"))).withColumn("sample_time", F.when(k % 5 != 0, k + 0.5))
    return rounded(readers.telemetry_aliases(t), "frame_count timestamp", "start_seconds")


@query(f"{B} SELECT dataset_id, frame_count, round(2 * {o.num(math.pi)} * {o.R} * cos({o.rad('latitude')}) / (256.0::DOUBLE * {1 << 18}), 6) AS gsd_m FROM valid")
def tile_scale(spark, sf):
    return _valid(spark, sf).select("dataset_id", "frame_count", F.round(geo.tile_gsd("latitude", 18), 6).alias("gsd_m"))


@query(f"{B} SELECT dataset_id, frame_count, round(start_seconds - lag(start_seconds) OVER {o.W}, 6) AS gap_s FROM fx WHERE source = 'SAT'")
def fix_gaps(spark, sf):
    return rounded(gating.fix_gaps(views.fixes(spark, sf).where("source = 'SAT'")), "dataset_id frame_count", "gap_s")
