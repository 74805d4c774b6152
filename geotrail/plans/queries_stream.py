"""Streaming queries: fixes derived from the events file, run through the stateful loop until nothing is left."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.scratch import shared_folder, written
from ..streaming import ordered
from ..streaming.causal import localise
from . import oracle as o
from . import queries_retrieval, views
from .registry import query, rounded, rounded_sql

_S = "dataset_id frame_count", "", "filled_lat filled_lon smoothed_lat smoothed_lon"


def _folder(spark) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _middle(rows: DataFrame, column: str) -> float:
    """About the median: where a stream is cut, its output is the same, so no task need hold all values."""
    return rows.agg(F.percentile_approx(column, 0.5)).first()[0] or 0.0


def _streamed(spark, sf) -> DataFrame:
    """The fixes view written as files in time order, read as a stream of micro-batches, and its output as a table."""
    at = _folder(spark)
    fixes = written(views.fixes(spark, sf))  # the parts read it, not the view
    half = _middle(fixes, "start_seconds")
    fixes.where(F.col("start_seconds") <= half).write.parquet(f"{at}/in/part=1")
    fixes.where(F.col("start_seconds") > half).write.parquet(f"{at}/in/part=2")
    out = None
    for part in (1, 2):  # one run per part: the second goes on from the first one's checkpoint
        stream = spark.readStream.schema(fixes.schema).parquet(f"{at}/in/part={{{','.join(str(p) for p in range(1, part + 1))}}}")
        run = localise(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start(f"{at}/out")
        run.awaitTermination()
        out = spark.read.parquet(f"{at}/out")
    return out


@query(f"{o.BASE}, s AS (SELECT *, cf_lat AS filled_lat, cf_lon AS filled_lon, {o.causal('cf_lat', 4)} AS smoothed_lat, {o.causal('cf_lon', 4)} AS smoothed_lon FROM ff) SELECT {rounded_sql(*_S)} FROM s")
def stream_causal_localise(spark, sf):
    return rounded(_streamed(spark, sf), *_S)


@query(f"{o.BASE} SELECT dataset_id, frame_count, round(cf_lat, 8) AS lat FROM ff WHERE cf_lat IS NOT NULL")
def stream_ffill(spark, sf):
    return _streamed(spark, sf).where("filled_lat is not null").select("dataset_id", "frame_count", F.round("filled_lat", 8).alias("lat"))


# --- rows out of order: each part is a run of its own, and the last one only moves the watermark on, which ends all flights

#: Event times begin here; a delay of so many seconds holds the jitter of arrival; a gap that no flight has.
EPOCH_US, DELAY_S, GAP_S = 10**15, 600_000.0, 400 * 86_400.0
LAST_FLIGHT = -1


def _out_of_order(spark, rows: DataFrame, jitter_s, loop) -> DataFrame:
    """``rows`` (with ``us``) in two parts, parted by time and ``jitter_s``, through ``loop``; the rows that come out."""
    at = _folder(spark)
    rows = written(rows)  # four passes follow
    half = _middle(rows, "us")
    early = F.col("us") + jitter_s * 1e6 <= half
    rows.where(early).write.parquet(f"{at}/in/part=1")
    rows.where(~early).write.parquet(f"{at}/in/part=2")
    end = rows.schema["dataset_id"].dataType.simpleString()
    last = rows.agg(F.max("us").alias("us")).select(F.lit(LAST_FLIGHT).cast(end).alias("dataset_id"), (F.coalesce("us", F.lit(EPOCH_US)) + F.lit(int(2 * GAP_S * 1e6))).alias("us"), *[F.lit(0 if t.startswith(("big", "int", "double")) else None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("dataset_id", "us")])
    last.select(*rows.columns).write.parquet(f"{at}/in/part=3")
    for part in (1, 2, 3):
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in/part={{{','.join(str(p) for p in range(1, part + 1))}}}")
        run = loop(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start(f"{at}/out")
        run.awaitTermination()
    return spark.read.parquet(f"{at}/out").where(F.col("dataset_id") != F.lit(LAST_FLIGHT).cast(end))


def _timed(f: DataFrame) -> DataFrame:
    return f.withColumn("us", F.lit(EPOCH_US) + F.round(F.col("start_seconds") * 1e6).cast("long"))


@query(f"{o.BASE}, s AS (SELECT *, cf_lat AS filled_lat, cf_lon AS filled_lon, {o.causal('cf_lat', 4)} AS smoothed_lat, {o.causal('cf_lon', 4)} AS smoothed_lon FROM ff) SELECT {rounded_sql(*_S)} FROM s")
def stream_reordered(spark, sf):
    fixes = _timed(views.fixes(spark, sf)).select("dataset_id", "us", "frame_count", "raw_lat", "raw_lon")
    jitter = (F.col("frame_count") * 7919 % 101 - 50) / 101 * DELAY_S
    out = _out_of_order(spark, fixes, jitter, lambda s: ordered.localise_unordered(s, DELAY_S, GAP_S))
    return rounded(out.where("not late"), *_S)


# --- the feedback loop: a satellite search succeeds where the frame lies close to the place that it is centred on

#: Degrees around the centre that a mosaic shows.
SEEN_DEG = 4e-4


def satellite_by_rule(row: dict, lat: float, lon: float) -> tuple[str, int, float | None, float | None]:
    if abs(row["gt_lat"] - lat) > SEEN_DEG or abs(row["gt_lon"] - lon) > SEEN_DEG:
        return "few_matches", 0, None, None
    if row["k"] % 23 < 8:
        return "ransac_fail", row["k"] % 23, None, None
    i = row["frame_count"]
    return "ok", 8 + row["k"] % 50, row["gt_lat"] + (i * 37 % 101 - 50) * 1e-6, row["gt_lon"] + (i * 53 % 101 - 50) * 1e-6


def retrieval_by_rule(row: dict) -> tuple[int, float, float | None, float | None]:
    return row["k"] * 3, row["k"] % 10 / 10, row["gt_lat"] + (row["k"] - 50) * 1e-6, row["gt_lon"]


_w = "[" + ", ".join(o.num(geo.gauss(j, 2.4)) for j in range(9)) + "]"
_now = lambda v: f"CASE WHEN len({v}) > 0 THEN list_sum(list_transform(range(0, len({v})), lambda j: {_w}[j + 1] * {v}[len({v}) - j])) / list_sum({_w}[1:len({v})]) END"
_far = f"(rel_alt / {o.num(math.tan(math.radians(45.0)))})"
LIVE_SQL = f"""{o.BASE}, lf AS (SELECT dataset_id, seq, frame_count, rel_alt, k, gt_lat, gt_lon, CASE WHEN k % 11 <> 0 THEN k * 3.0::DOUBLE END AS heading_deg FROM fx),
lv AS (
  SELECT dataset_id, 0::BIGINT AS seq, 0::BIGINT AS frame_count, ''::VARCHAR AS sat_status, 0::INTEGER AS sat_inliers, NULL::DOUBLE AS centre_lat, NULL::DOUBLE AS centre_lon, ''::VARCHAR AS source, NULL::DOUBLE AS raw_lat, NULL::DOUBLE AS raw_lon,
    []::DOUBLE[] AS lats, []::DOUBLE[] AS lons, 0::BIGINT AS satellite_calls, 0::BIGINT AS retrieval_calls, NULL::DOUBLE AS s_lat, NULL::DOUBLE AS s_lon FROM (SELECT DISTINCT dataset_id FROM fx)
  UNION ALL
  SELECT dataset_id, seq, frame_count, sat_status, sat_inliers, c_lat, c_lon, source, raw_lat, raw_lon, lats, lons, satellite_calls, retrieval_calls, {_now('lats')}, {_now('lons')} FROM (
  SELECT *, CASE WHEN f_lat IS NULL THEN o_lats ELSE list_append(o_lats, f_lat)[-9:] END AS lats, CASE WHEN f_lat IS NULL THEN o_lons ELSE list_append(o_lons, f_lon)[-9:] END AS lons FROM (
  SELECT *, coalesce(raw_lat, o_lats[-1]) AS f_lat, coalesce(raw_lon, o_lons[-1]) AS f_lon FROM (
  SELECT *, CASE source WHEN 'SAT' THEN gt_lat + (frame_count * 37 % 101 - 50) * 1e-6 WHEN 'VPR_FALLBACK' THEN gt_lat + (k - 50) * 1e-6 END AS raw_lat,
    CASE source WHEN 'SAT' THEN gt_lon + (frame_count * 53 % 101 - 50) * 1e-6 WHEN 'VPR_FALLBACK' THEN gt_lon END AS raw_lon, o_rc + CASE WHEN source = 'SAT' THEN 0 ELSE 1 END AS retrieval_calls FROM (
  SELECT *, CASE WHEN sat_status = 'ok' THEN 'SAT' WHEN k * 3 >= 100 AND k % 10 >= 7 THEN 'VPR_FALLBACK' ELSE 'NO_FIX' END AS source,
    CAST(CASE sat_status WHEN 'ok' THEN 8 + k % 50 WHEN 'ransac_fail' THEN k % 23 ELSE 0 END AS INTEGER) AS sat_inliers FROM (
  SELECT *, o_sc + CASE WHEN c_lat IS NULL THEN 0 ELSE 1 END AS satellite_calls, CASE WHEN c_lat IS NULL THEN why WHEN abs(gt_lat - c_lat) > {SEEN_DEG!r}::DOUBLE OR abs(gt_lon - c_lon) > {SEEN_DEG!r}::DOUBLE THEN 'few_matches' WHEN k % 23 < 8 THEN 'ransac_fail' ELSE 'ok' END AS sat_status FROM (
  SELECT *, CASE WHEN why = '' THEN p_lat + {_far} * cos({o.rad('heading_deg')}) / {geo.METRES_PER_DEGREE!r}::DOUBLE END AS c_lat,
    CASE WHEN why = '' THEN p_lon + {_far} * sin({o.rad('heading_deg')}) / ({geo.METRES_PER_DEGREE!r}::DOUBLE * cos({o.rad('p_lat')})) END AS c_lon FROM (
  SELECT lf.*, lv.lats AS o_lats, lv.lons AS o_lons, lv.s_lat AS p_lat, lv.s_lon AS p_lon, lv.satellite_calls AS o_sc, lv.retrieval_calls AS o_rc,
    CASE WHEN lv.s_lat IS NULL THEN 'no_position_yet' WHEN rel_alt IS NULL OR rel_alt < 20 THEN 'low_alt' WHEN heading_deg IS NULL THEN 'no_heading_yet' ELSE '' END AS why
  FROM lv JOIN lf ON lf.dataset_id = lv.dataset_id AND lf.seq = lv.seq + 1))))))))
"""
_L = "dataset_id frame_count sat_status sat_inliers source satellite_calls retrieval_calls", "", "centre_lat centre_lon raw_final_lat raw_final_lon smoothed_lat smoothed_lon"


@query(f"{LIVE_SQL}, out AS (SELECT *, raw_lat AS raw_final_lat, raw_lon AS raw_final_lon, s_lat AS smoothed_lat, s_lon AS smoothed_lon FROM lv WHERE seq > 0) SELECT {rounded_sql(*_L)} FROM out")
def stream_live_loop(spark, sf):
    f = _timed(views.fixes(spark, sf)).withColumn("heading_deg", F.when(F.col("k") % 11 != 0, F.col("k") * 3.0))
    f = f.select("dataset_id", "us", "frame_count", "rel_alt", "heading_deg", "k", "gt_lat", "gt_lon")
    jitter = (F.col("frame_count") * 7919 % 101 - 50) / 101 * DELAY_S
    loop = lambda s: ordered.live_loop(s, satellite_by_rule, retrieval_by_rule, "k gt_lat gt_lon", DELAY_S, GAP_S)
    return rounded(_out_of_order(spark, f, jitter, loop).where("not late"), *_L)


@query(queries_retrieval.ONLINE_SQL)
def stream_fixed_lag(spark, sf):
    c = queries_retrieval._steps(spark, sf).select("dataset_id", (F.lit(EPOCH_US) + F.col("q") * 1_000_000).alias("us"), F.col("q").alias("frame_count"), F.col("rank").cast("int").alias("rank"), "unary", "x_m", "y_m")
    jitter = F.col("frame_count") * 31 % 11 - 5.0
    out = _out_of_order(spark, c, jitter, lambda s: ordered.decode_stream(s, 3, 12.0, GAP_S))
    return out.where("not late").select("dataset_id", "step", "rank")
