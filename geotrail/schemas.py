"""Explicit schemas of the tables that the engine reads and writes (DDL strings)."""

from __future__ import annotations

#: Order is meaning: rows carry ``seq``.
TELEMETRY = (
    "subtitle_index long, start_time string, end_time string, start_seconds double, end_seconds double, frame_count long, diff_time_ms long, timestamp string, iso double, shutter string, "
    "fnum double, ev double, color_md string, focal_len double, latitude double, longitude double, rel_alt double, abs_alt double, ct double"
)
TELEMETRY_CSV = TELEMETRY + ", drone_yaw double, gimbal_pitch double, gimbal_yaw double, gps_datetime string, sample_time double"
MANIFEST = (
    "frame_count long, frame_path string, timestamp string, start_seconds double, drone_latitude double, drone_longitude double, rel_alt_m double, heading_deg double, heading_source string, "
    "camera_angle_deg double, camera_angle_source string, ground_latitude double, ground_longitude double"
)
CANDIDATES = "q long, r long, rank int, sim double, lg_match_count long, lg_mean_score double, lg_inlier_count long, lg_inlier_ratio double"
DECISIONS = "query_frame_count long, time_s double, decision string, seconds_since_previous_fix double, position_error_m double, is_good_fix boolean"
SATELLITE = "frame_count long, status string, error_m double, matches int, inliers int, est_lat double, est_lon double"
TILE_META = "north double, south double, west double, east double, zoom int, tile_x int, tile_y int, gsd_m double"
