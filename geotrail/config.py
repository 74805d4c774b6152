"""Parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Projection:
    camera_angle_deg: float = 45.0
    angle_reference: str = "below_horizon"
    heading_window: int = 30
    min_displacement_m: float = 2.0
    heading_source: str = "auto"  # auto, trajectory, drone_yaw, gimbal_yaw
    camera_angle_source: str = "fixed"  # auto, fixed, gimbal_pitch


@dataclass(frozen=True)
class Costs:
    similarity_weight: float = 4.0
    inlier_weight: float = 1.0
    ratio_weight: float = 1.0
    max_step_m: float = 35.0
    transition_weight: float = 4.0
    acceleration_scale_m: float = 20.0
    acceleration_weight: float = 1.0
    direction_scale_deg: float = 45.0
    direction_weight: float = 0.0
    min_direction_step_m: float = 3.0


@dataclass(frozen=True)
class Gate:
    good_error_m: float = 20.0
    min_coverage: float = 0.30
    max_gap_s: float = 15.0


@dataclass(frozen=True)
class Live:
    zoom: int = 18
    min_altitude_m: float = 20.0
    min_matches: int = 8
    min_inliers: int = 8
    vpr_inliers: int = 100
    vpr_ratio: float = 0.70
    grid: int = 3
    half_window: int = 4


#: The thresholds of the gate sweep, in nesting order.
RANKS = (1, 2, 3, 4, 6)
INLIERS = (50, 100, 150, 200, 300, 500)
RATIOS = (0.60, 0.70, 0.80, 0.90, 0.95)
SIMILARITIES = (0.90, 0.94, 0.96, 0.98, 0.99)
