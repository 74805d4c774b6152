"""Contracts of neural and image providers, whose weights are not part of the engine.

A provider is a function from key rows to result rows; the default looks results up in tables. Keys are scored once:
repeated pairs of one provider call are joined back to its distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: (dataset_id, frame_count, frame_path) -> those and v array<float>
DescriptorProvider = Callable[[DataFrame], DataFrame]
#: (q, r) -> those and lg_match_count, lg_mean_score, lg_inlier_count, lg_inlier_ratio
MatchProvider = Callable[[DataFrame], DataFrame]
#: (dataset_id, frame_count, centre_lat, centre_lon) -> those and sat_status, inliers, est_lat, est_lon
SatelliteProvider = Callable[[DataFrame], DataFrame]


def from_table(table: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The default provider: a left join on the keys."""
    return lambda rows: rows.join(table, keys, "left")


def scored_once(provider: Callable[[DataFrame], DataFrame], keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.join(provider(rows.select(*keys).distinct()), keys, "left")
