"""The causal loop as Structured Streaming: per flight, fill and smooth each fix as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import gauss

OUTPUT = "dataset_id long, frame_count long, filled_lat double, filled_lon double, smoothed_lat double, smoothed_lon double"
#: The last filled positions, newest last: as many as the window reads.
STATE = "lats array<double>, lons array<double>"


def advance(rows: pd.DataFrame, lats: list[float], lons: list[float], half: int) -> tuple[pd.DataFrame, list[float], list[float]]:
    """Rows of one flight in order, given the positions before them."""
    weights = np.array([gauss(j, 0.6 * half) if half else 1.0 for j in range(2 * half + 1)])
    raw = rows[["raw_lat", "raw_lon"]].to_numpy(np.float64)
    known = ~np.isnan(raw).any(axis=1)
    before = np.column_stack([np.asarray(lats, float), np.asarray(lons, float)])
    last = np.maximum.accumulate(np.where(known, np.arange(len(raw)), -1)) if len(raw) else np.zeros(0, np.int64)
    have = (last >= 0) | (len(before) > 0)
    filled = np.where((last >= 0)[:, None], raw[last], before[-1] if len(before) else np.nan) if len(raw) else raw
    track = np.concatenate([before, filled[have]])  # rows without a position are the first ones
    total, weight = np.zeros_like(track), np.zeros(len(track))
    for j, w in enumerate(weights[: len(track)]):
        total[j:] += w * track[: len(track) - j]
        weight[j:] += w
    smooth = np.full_like(filled, np.nan)
    smooth[have] = (total / np.maximum(weight, np.finfo(float).tiny)[:, None])[len(before) :]
    made = pd.DataFrame({
        "dataset_id": rows["dataset_id"].to_numpy(), "frame_count": rows["frame_count"].to_numpy(),
        "filled_lat": filled[:, 0], "filled_lon": filled[:, 1], "smoothed_lat": smooth[:, 0], "smoothed_lon": smooth[:, 1],
    })
    kept = track[-len(weights) :]
    return made, kept[:, 0].tolist(), kept[:, 1].tolist()


def localise(fixes: DataFrame, half: int = 4) -> DataFrame:
    """A stream of fixes (dataset_id long, frame_count, start_seconds, raw_lat, raw_lon) as filled and smoothed positions.

    A flight's rows must arrive in order across micro-batches; within one they are sorted. Rows before the first fix
    come out with nulls. State per flight: the last ``2 * half + 1`` positions.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        rows = rows.take(np.lexsort((rows["frame_count"].to_numpy(), rows["start_seconds"].to_numpy())))
        lats, lons = state.get if state.exists else ([], [])
        made, lats, lons = advance(rows, lats, lons, half)
        state.update((lats, lons))
        yield made

    slim = fixes.select("dataset_id", "frame_count", "start_seconds", "raw_lat", "raw_lon")
    return slim.groupBy("dataset_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
