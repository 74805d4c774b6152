"""Geodesy, camera and web-map tile arithmetic as Column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth radius of all distances, and metres of a degree where offsets are made from metres.
EARTH_RADIUS_M = 6378137.0
METRES_PER_DEGREE = 111320.0


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Equirectangular metres east and north of an origin."""
    lat, lon, lat0, lon0 = map(c, (lat, lon, lat0, lon0))
    east = (F.radians(lon) - F.radians(lon0)) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M
    return east, (F.radians(lat) - F.radians(lat0)) * EARTH_RADIUS_M


def from_local_xy(x, y, lat0, lon0) -> tuple[Column, Column]:
    x, y, lat0, lon0 = map(c, (x, y, lat0, lon0))
    lat = F.degrees(y / EARTH_RADIUS_M + F.radians(lat0))
    return lat, F.degrees(x / (F.cos(F.radians(lat0)) * EARTH_RADIUS_M) + F.radians(lon0))


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def position_error(lat_a, lon_a, lat_b, lon_b, lat0, lon0) -> Column:
    """Planar distance of two points in the local frame of an origin."""
    ax, ay = local_xy(lat_a, lon_a, lat0, lon0)
    bx, by = local_xy(lat_b, lon_b, lat0, lon0)
    return length(ax - bx, ay - by)


def haversine(lat_a, lon_a, lat_b, lon_b) -> Column:
    lat_a, lon_a, lat_b, lon_b = map(c, (lat_a, lon_a, lat_b, lon_b))
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    a = half(lat_b - lat_a) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_b - lon_a)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def heading(dx: Column, dy: Column, least_m: float = 1e-6) -> Column:
    """Degrees clockwise from north of an east/north displacement; null below ``least_m``."""
    return F.when(length(dx, dy) >= least_m, F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)))


def normalize_heading(deg) -> Column:
    return F.pmod(c(deg) + 360.0, F.lit(360.0))


def heading_vector(deg) -> tuple[Column, Column]:
    return F.sin(F.radians(c(deg))), F.cos(F.radians(c(deg)))


def is_finite(x) -> Column:
    x = c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ground_distance(altitude, angle, reference: str = "below_horizon") -> Column:
    """Horizontal distance to the point that a tilted camera looks at; 0 at or below the ground, infinite at the horizon."""
    altitude, tangent = c(altitude), F.tan(F.radians(c(angle)))
    if reference == "below_horizon":
        far = F.when(F.abs(tangent) < 1e-9, float("inf")).otherwise(altitude / tangent)
    elif reference == "from_nadir":
        far = altitude * tangent
    else:
        raise ValueError(f"unknown angle reference {reference!r}")
    return F.when(~F.isnan(altitude) & (altitude <= 0), 0.0).otherwise(far)


def lerp(a, b, t) -> Column:
    return c(a) + (c(b) - c(a)) * c(t)


def offset_degrees(lat, lon, north_m, east_m) -> tuple[Column, Column]:
    lat, lon = c(lat), c(lon)
    return lat + c(north_m) / METRES_PER_DEGREE, lon + c(east_m) / (METRES_PER_DEGREE * F.cos(F.radians(lat)))


# --- camera


def vertical_fov(hfov_deg: float, width: int, height: int) -> float:
    return 2.0 * math.atan(math.tan(math.radians(hfov_deg) / 2.0) * height / width)


def camera_matrix(width: int, height: int, hfov_deg: float = 82.0) -> dict[str, float]:
    half_v = vertical_fov(hfov_deg, width, height) / 2.0
    return {"fx": width / (2.0 * math.tan(math.radians(hfov_deg) / 2.0)), "fy": height / (2.0 * math.tan(half_v)), "cx": width / 2.0, "cy": height / 2.0}


def camera_rotation(angle, heading_deg) -> list[list[Column]]:
    """Rows of the rotation from camera (right, down, forward) to east, north, up."""
    th, psi = F.radians(c(angle)), F.radians(c(heading_deg))
    st, ct, sp, cp = F.sin(th), F.cos(th), F.sin(psi), F.cos(psi)
    return [[cp, -st * sp, ct * sp], [-sp, -st * cp, ct * cp], [F.lit(0.0), -ct, -st]]


def camera_centre(altitude, angle, heading_deg) -> tuple[Column, Column]:
    """East and north of the point that the image centre shows, from the drone."""
    tangent = F.tan(F.radians(c(angle)))
    far = F.when(F.abs(tangent) < 1e-6, 0.0).otherwise(c(altitude) / tangent)
    east, north = heading_vector(heading_deg)
    return far * east, far * north


def footprint(altitude, angle, hfov_deg: float = 82.0, width: int = 1920, height: int = 1080) -> tuple[Column, Column]:
    """Width and depth of the ground in view; infinite for a level camera."""
    altitude, th = c(altitude), F.radians(c(angle))
    half_v = vertical_fov(hfov_deg, width, height) / 2.0
    tangent = F.tan(th)
    centre = altitude / tangent
    near = F.when(th + half_v < math.pi / 2, altitude / F.tan(th + half_v)).otherwise(0.0)
    far = F.when(th - half_v > 0, altitude / F.tan(th - half_v)).otherwise(float("inf"))
    level = F.abs(tangent) < 1e-6
    across = 2.0 * centre * math.tan(math.radians(hfov_deg) / 2.0)
    return F.when(level, float("inf")).otherwise(across), F.when(level, float("inf")).otherwise(F.least(far, 2.0 * centre) - near)


def gsd_at_centre(altitude, from_nadir_deg: float = 30.0, hfov_deg: float = 82.1, width: int = 1920) -> Column:
    focal = (width / 2) / math.tan(math.radians(hfov_deg / 2))
    return F.when(c(altitude) <= 0, 0.0).otherwise(c(altitude) / math.cos(math.radians(from_nadir_deg)) / focal)


# --- web-map tiles


def tile_x(lon, zoom: int) -> Column:
    return ((c(lon) + 180.0) / 360.0 * (1 << zoom)).cast("long")


def tile_y(lat, zoom: int) -> Column:
    r = F.radians(c(lat))
    return ((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * (1 << zoom)).cast("long")


def tile_west(x, zoom: int) -> Column:
    return c(x) / (1 << zoom) * 360.0 - 180.0


def tile_north(y, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi - 2.0 * math.pi * c(y) / (1 << zoom))))


def tile_gsd(lat, zoom: int, tile_px: int = 256) -> Column:
    return 2 * math.pi * EARTH_RADIUS_M * F.cos(F.radians(c(lat))) / (tile_px * (1 << zoom))


def tile_pixel(lat, lon, north, south, west, east, tile_px: int = 256) -> tuple[Column, Column]:
    lat, lon, north, south, west, east = map(c, (lat, lon, north, south, west, east))
    return (lon - west) / (east - west) * tile_px, (north - lat) / (north - south) * tile_px


def pixel_position(px, py, north, south, west, east, tile_px: int = 256) -> tuple[Column, Column]:
    px, py, north, south, west, east = map(c, (px, py, north, south, west, east))
    return north - py / tile_px * (north - south), west + px / tile_px * (east - west)


def homography_point(h: list, x, y) -> tuple[Column, Column]:
    """Image of a point under a 3x3 matrix given row by row."""
    h, x, y = [c(v) for v in h], c(x), c(y)
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


# --- sequence costs


def unary_cost(similarity, inliers, ratio, weights: tuple[float, float, float] = (4.0, 1.0, 1.0)) -> Column:
    return -weights[0] * c(similarity) - weights[1] * F.log1p(c(inliers)) - weights[2] * c(ratio)


def step_cost(distance: Column, max_step_m: float = 35.0, weight: float = 4.0) -> Column:
    return weight * F.pow(F.greatest(F.lit(0.0), distance - max_step_m) / max(max_step_m, 1e-6), F.lit(2.0))


def acceleration_cost(ddx: Column, ddy: Column, scale_m: float = 20.0, weight: float = 1.0) -> Column:
    return weight * F.pow(length(ddx, ddy) / max(scale_m, 1e-6), F.lit(2.0))


def direction_cost(ax: Column, ay: Column, bx: Column, by: Column, scale_deg: float = 45.0, weight: float = 0.0, min_step_m: float = 3.0) -> Column:
    """Cost of the turn between two steps; none for short steps or without a weight."""
    if weight <= 0:
        return F.lit(0.0)
    a, b = length(ax, ay), length(bx, by)
    turn = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ax * bx + ay * by) / (a * b)))))
    return F.when((a < min_step_m) | (b < min_step_m), 0.0).otherwise(weight * F.pow(turn / max(scale_deg, 1e-6), F.lit(2.0)))


def gauss(i: int, sigma: float) -> float:
    return math.exp(-0.5 * (i / sigma) ** 2)
