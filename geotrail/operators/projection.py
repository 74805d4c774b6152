"""From telemetry to ground points: headings, camera angles, projection and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Projection
from ..functions import geo
from .sequence import FLIGHT, with_headings, with_local_xy


def select_heading(estimate: str, source: str) -> Column:
    """Of the source asked for, or else the first there is of gimbal, drone and trajectory."""
    yaw = {s: geo.normalize_heading(s) for s in ("gimbal_yaw", "drone_yaw")}
    if source == "trajectory":
        return F.col(estimate)
    first = [yaw[source]] if source in yaw else []
    return F.coalesce(*first, yaw["gimbal_yaw"], yaw["drone_yaw"], F.col(estimate))


def heading_label(source: str) -> Column:
    if source != "auto":
        return F.lit(source)
    return F.when(F.col("gimbal_yaw").isNotNull(), "gimbal_yaw").when(F.col("drone_yaw").isNotNull(), "drone_yaw").otherwise("trajectory")


def camera_angle(cfg: Projection) -> Column:
    fixed = F.lit(cfg.camera_angle_deg)
    return fixed if cfg.camera_angle_source == "fixed" else F.coalesce(F.abs("gimbal_pitch"), fixed)


def angle_label(cfg: Projection) -> Column:
    if cfg.camera_angle_source != "auto":
        return F.lit(cfg.camera_angle_source)
    return F.when(F.col("gimbal_pitch").isNotNull(), "gimbal_pitch").otherwise("fixed")


def ground_projection(telemetry: DataFrame, cfg: Projection = Projection()) -> DataFrame:
    """Ground points of valid telemetry rows. The live heading is causal; the ground point is for evaluation and may look
    ahead. No heading or an infinite distance leaves the ground point NaN, a null altitude leaves it null."""
    t = with_headings(with_local_xy(telemetry), cfg.heading_window, cfg.min_displacement_m)
    t = t.withColumn("heading_deg", select_heading("causal_heading", cfg.heading_source)).withColumn("__gt", select_heading("centred_heading", cfg.heading_source))
    t = t.withColumn("camera_angle_deg", camera_angle(cfg))
    t = t.withColumn("ground_distance_m", geo.ground_distance("rel_alt", "camera_angle_deg", cfg.angle_reference))
    east, north = geo.heading_vector("__gt")
    fine = F.col("__gt").isNotNull() & geo.is_finite("ground_distance_m")
    nan = F.lit(float("nan"))
    unknown = F.col("ground_distance_m").isNull()
    put = lambda v: F.when(unknown, F.lit(None).cast("double")).when(fine, v).otherwise(nan)
    t = t.withColumn("ground_x_m", put(F.col("x_m") + F.col("ground_distance_m") * east)).withColumn("ground_y_m", put(F.col("y_m") + F.col("ground_distance_m") * north))
    lat, lon = geo.from_local_xy("ground_x_m", "ground_y_m", "lat0", "lon0")
    return t.withColumn("ground_latitude", lat).withColumn("ground_longitude", lon).select(
        FLIGHT, "seq", "frame_count", "start_seconds", F.col("latitude").alias("drone_latitude"), F.col("longitude").alias("drone_longitude"),
        F.col("x_m").alias("drone_x_m"), F.col("y_m").alias("drone_y_m"), F.col("rel_alt").alias("rel_alt_m"), "heading_deg",
        heading_label(cfg.heading_source).alias("heading_source"), "camera_angle_deg", angle_label(cfg).alias("camera_angle_source"),
        "ground_distance_m", "ground_x_m", "ground_y_m", "ground_latitude", "ground_longitude")


def projection_summary(projection: DataFrame) -> DataFrame:
    """Extents per flight; 0 where there is no number."""
    num = lambda c: F.when(geo.is_finite(c), F.col(c))
    cols = []
    for c in ("rel_alt_m", "ground_distance_m", "ground_x_m", "ground_y_m"):
        cols += [F.coalesce(F.min(num(c)), F.lit(0.0)).alias(f"{c}_min"), F.coalesce(F.max(num(c)), F.lit(0.0)).alias(f"{c}_max")]
    return projection.groupBy(FLIGHT).agg(F.count("*").alias("row_count"), *cols)


def telemetry_summary(rows: DataFrame) -> DataFrame:
    """Per flight: rows, valid rows, first valid time, last row's end, extents."""
    valid = (F.abs("latitude") > 1e-9) & (F.abs("longitude") > 1e-9)
    return rows.groupBy(FLIGHT).agg(
        F.count("*").alias("row_count"), F.count_if(valid).alias("valid_gps_rows"), F.min_by("start_seconds", F.when(valid, F.col("seq"))).alias("first_valid_seconds"),
        F.max_by("start_seconds", "seq").alias("duration_seconds"), F.min("latitude").alias("latitude_min"), F.max("latitude").alias("latitude_max"),
        F.min("longitude").alias("longitude_min"), F.max("longitude").alias("longitude_max"), F.min("rel_alt").alias("rel_alt_min"), F.max("rel_alt").alias("rel_alt_max"))
