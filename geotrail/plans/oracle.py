"""DuckDB SQL of the registered queries, written apart from the operators: plain joins, windows and recursion."""

from __future__ import annotations

import math

from .. import config
from ..functions.geo import EARTH_RADIUS_M, camera_matrix, gauss, vertical_fov  # noqa: F401

R = f"{EARTH_RADIUS_M}::DOUBLE"


def num(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def rad(x: str) -> str:
    return f"(({x}) * 0.017453292519943295::DOUBLE)"


def deg(x: str) -> str:
    return f"(({x}) * 57.29577951308232::DOUBLE)"


def xy(lat: str, lon: str, lat0: str, lon0: str) -> tuple[str, str]:
    return f"(({rad(lon)} - {rad(lon0)}) * cos({rad(lat0)}) * {R})", f"(({rad(lat)} - {rad(lat0)}) * {R})"


def length(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


def haversine(a: str, b: str, c: str, d: str) -> str:
    half = lambda x: f"pow(sin({rad(x)} / 2), 2)"
    return f"(2 * {R} * asin(sqrt({half(f'{c} - {a}')} + cos({rad(a)}) * cos({rad(c)}) * {half(f'{d} - {b}')})))"


def heading(dx: str, dy: str) -> str:
    return f"(CASE WHEN {length(dx, dy)} >= 1e-6 THEN fmod(fmod({deg(f'atan2({dx}, {dy})')} + 360.0::DOUBLE, 360.0::DOUBLE) + 360.0::DOUBLE, 360.0::DOUBLE) END)"


def tile_x(lon: str, z: int = 18) -> str:
    return f"CAST(trunc((({lon}) + 180.0::DOUBLE) / 360.0::DOUBLE * {1 << z}) AS BIGINT)"


def tile_y(lat: str, z: int = 18) -> str:
    r = rad(lat)
    return f"CAST(trunc((1.0::DOUBLE - ln(tan({r}) + 1.0::DOUBLE / cos({r})) / {num(math.pi)}) / 2.0::DOUBLE * {1 << z}) AS BIGINT)"


def west(x: str, z: int = 18) -> str:
    return f"(({x})::DOUBLE / {1 << z} * 360.0::DOUBLE - 180.0::DOUBLE)"


def north(y: str, z: int = 18) -> str:
    n = f"({num(math.pi)} - {num(2 * math.pi)} * ({y})::DOUBLE / {1 << z})"
    return deg(f"atan((exp({n}) - exp(-{n})) / 2)")


BASE = f"""
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
e2 AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq, (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS start_seconds FROM ev),
tel AS (
  SELECT user_id AS dataset_id, seq, event_id AS frame_count, start_seconds, event_type, k,
         CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 32.10::DOUBLE + seq * 2e-5 + event_id % 7 * 1e-6 END AS latitude,
         CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 35.20::DOUBLE + seq * 3e-5 + event_id % 11 * 1e-6 END AS longitude,
         CASE WHEN k % 10 <> 0 THEN value / 4 END AS rel_alt, CASE WHEN k % 3 = 0 THEN k * 7.0::DOUBLE - 180 END AS drone_yaw,
         CASE WHEN k % 5 = 0 THEN -60.0::DOUBLE + k % 10 END AS gimbal_pitch, event_type = 'view' AS is_frame
  FROM e2),
valid AS (SELECT * FROM tel WHERE abs(latitude) > 1e-9 AND abs(longitude) > 1e-9),
o AS (
  SELECT *, first_value(latitude) OVER w AS lat0, first_value(longitude) OVER w AS lon0 FROM valid
  WINDOW w AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_count)),
vxy AS (SELECT *, {xy('latitude', 'longitude', 'lat0', 'lon0')[0]} AS x_m, {xy('latitude', 'longitude', 'lat0', 'lon0')[1]} AS y_m FROM o),
dd AS (
  SELECT *, x_m - first_value(x_m) OVER c AS cdx, y_m - first_value(y_m) OVER c AS cdy,
         last_value(x_m) OVER b - first_value(x_m) OVER b AS bdx, last_value(y_m) OVER b - first_value(y_m) OVER b AS bdy
  FROM vxy WINDOW c AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN 30 PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
hh AS (
  SELECT *, CASE WHEN {length('cdx', 'cdy')} >= 2 THEN {heading('cdx', 'cdy')} END AS hc, CASE WHEN {length('bdx', 'bdy')} >= 2 THEN {heading('bdx', 'bdy')} END AS hb FROM dd),
heads AS (
  SELECT *, last_value(hc IGNORE NULLS) OVER p AS causal_heading,
         coalesce(last_value(hb IGNORE NULLS) OVER p, first_value(hb IGNORE NULLS) OVER f) AS centred_heading
  FROM hh WINDOW p AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 f AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fr AS (
  SELECT 'v' || CAST(label AS VARCHAR) AS dataset_id, vec_id AS frame_count, CAST(vec_id AS DOUBLE) AS start_seconds,
         CASE WHEN vec_id % 5 = 1 THEN 'query' ELSE 'reference' END AS role,
         32.10::DOUBLE + CAST(embedding[1] AS DOUBLE) * 0.01::DOUBLE AS ground_latitude, 35.20::DOUBLE + CAST(embedding[2] AS DOUBLE) * 0.01::DOUBLE AS ground_longitude,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT q.frame_count AS q, r.frame_count AS r, q.dataset_id, r.dataset_id AS r_dataset, list_dot_product(q.v, r.v) AS sim,
         r.ground_latitude AS r_lat, r.ground_longitude AS r_lon, {length(f"{xy('q.ground_latitude', 'q.ground_longitude', '32.10::DOUBLE', '35.20::DOUBLE')[0]} - {xy('r.ground_latitude', 'r.ground_longitude', '32.10::DOUBLE', '35.20::DOUBLE')[0]}", f"{xy('q.ground_latitude', 'q.ground_longitude', '32.10::DOUBLE', '35.20::DOUBLE')[1]} - {xy('r.ground_latitude', 'r.ground_longitude', '32.10::DOUBLE', '35.20::DOUBLE')[1]}")} AS error_m
  FROM fr q JOIN fr r ON q.role = 'query' AND r.role = 'reference'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r DESC) AS rank FROM pairs),
c0 AS (SELECT *, (q * 31 + r * 17) % 900 AS lg_match_count FROM ranked WHERE rank <= 6),
c1 AS (SELECT *, (lg_match_count * ((q * 7 + r * 13) % 101)) // 100 AS lg_inlier_count FROM c0),
cand AS (
  SELECT *, CAST(lg_inlier_count AS DOUBLE) / greatest(lg_match_count, 1) AS lg_inlier_ratio,
         {xy('r_lat', 'r_lon', '32.10::DOUBLE', '35.20::DOUBLE')[0]} AS x_m, {xy('r_lat', 'r_lon', '32.10::DOUBLE', '35.20::DOUBLE')[1]} AS y_m,
         dense_rank() OVER (PARTITION BY dataset_id ORDER BY q) - 1 AS step FROM c1),
cu AS (SELECT *, -4.0::DOUBLE * sim - 1.0::DOUBLE * ln(1 + lg_inlier_count) - 1.0::DOUBLE * lg_inlier_ratio AS unary FROM cand),
fx0 AS (
  SELECT dataset_id, seq, frame_count, start_seconds, k, rel_alt,
         CASE WHEN event_type IN ('click', 'view') THEN 'SAT' WHEN event_type = 'purchase' THEN 'VPR_FALLBACK' ELSE 'NO_FIX' END AS source,
         32.10::DOUBLE + seq * 2e-5 AS gt_lat, 35.20::DOUBLE + seq * 3e-5 AS gt_lon FROM tel),
fx AS (
  SELECT *, CASE WHEN source <> 'NO_FIX' THEN gt_lat + (frame_count * 37 % 101 - 50) * 1e-6 END AS raw_lat,
         CASE WHEN source <> 'NO_FIX' THEN gt_lon + (frame_count * 53 % 101 - 50) * 1e-6 END AS raw_lon FROM fx0),
ff AS (
  SELECT *, last_value(raw_lat IGNORE NULLS) OVER p AS cf_lat, last_value(raw_lon IGNORE NULLS) OVER p AS cf_lon,
         coalesce(last_value(raw_lat IGNORE NULLS) OVER p, first_value(raw_lat IGNORE NULLS) OVER f, 0.0::DOUBLE) AS bf_lat,
         coalesce(last_value(raw_lon IGNORE NULLS) OVER p, first_value(raw_lon IGNORE NULLS) OVER f, 0.0::DOUBLE) AS bf_lon
  FROM fx WINDOW p AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 f AS (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""

W = "(PARTITION BY dataset_id ORDER BY start_seconds, frame_count)"


def weighted(x: str, offsets: dict[int, float]) -> str:
    at = lambda k: x if k == 0 else f"lag({x}, {-k}) OVER {W}" if k < 0 else f"lead({x}, {k}) OVER {W}"
    top = " + ".join(f"coalesce({at(k)} * {num(g)}, 0.0::DOUBLE)" for k, g in offsets.items())
    low = " + ".join(f"CASE WHEN {at(k)} IS NOT NULL THEN {num(g)} ELSE 0.0::DOUBLE END" for k, g in offsets.items())
    return f"(CASE WHEN {x} IS NOT NULL THEN ({top}) / ({low}) END)"


def symmetric(x: str, h: int) -> str:
    return x if h == 0 else weighted(x, {k: gauss(k, 0.6 * h) for k in range(-h, h + 1)})


def causal(x: str, h: int) -> str:
    return x if h == 0 else weighted(x, {-k: gauss(k, 0.6 * h) for k in range(2 * h + 1)})


def grid_sql() -> str:
    from itertools import product

    rows = ", ".join(f"({k}, {a}, {b}, {c!r}::DOUBLE, {d!r}::DOUBLE)" for k, (a, b, c, d) in enumerate(product(config.RANKS, config.INLIERS, config.RATIOS, config.SIMILARITIES)))
    return f"g(grid_ord, max_rank, min_inliers, min_ratio, min_similarity) AS (VALUES {rows})"


def step_sql(a: str, b: str) -> str:
    d = length(f"{b}.x_m - {a}.x_m", f"{b}.y_m - {a}.y_m")
    return f"4.0::DOUBLE * pow(greatest(0.0::DOUBLE, {d} - 35.0::DOUBLE) / 35.0::DOUBLE, 2)"

