"""Flights as streams whose rows may arrive out of order: a reorder buffer in state, and three loops behind it.

Each flight has a watermark of its own, its latest event less ``delay_s``. Rows wait in the flight's state until that
watermark passes them and are then released in order, so a loop sees what it would see in an ordered run, whatever the
order of arrival within the delay. A row that comes when a later one of its flight has been released is late: it is not
handed on, but comes out with its place and the mark ``late``, counted per flight. The end of a flight is an event-time
timer: when Spark's watermark (latest event of all flights less ``gap_s``) has passed a flight's last event, the rest of
it is released and its state goes.

State of a flight: the rows of the last ``delay_s`` seconds, three numbers, and what the loop keeps, which is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Costs, Live, Projection
from ..functions.geo import METRES_PER_DEGREE, gauss
from ..operators.decoding import OnlineDecoder

NEVER = -(1 << 62)
#: The state store that holds timers and several states of a key.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """The buffer. A loop behind it gives ``fields`` (DDL of its output besides the key and ``late``) and ``memory`` (DDL
    of what it keeps), and says what to do ``start``, ``step`` by step and at the ``finish``."""

    fields: str
    memory: str

    def __init__(self, rows: T.StructType, delay_s: float):
        self.rows, self.delay = rows, int(delay_s * 1e6)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, kept: tuple, rows: list[dict]) -> tuple[tuple, list[tuple]]:
        """The loop's memory after some rows in order, and what comes out."""
        raise NotImplementedError

    def finish(self, kept: tuple) -> list[tuple]:
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.rows)
        self.mark = handle.getValueState("mark", "released long, seen long")
        self.kept = handle.getValueState("kept", self.memory)

    def _made(self, key: tuple, out: list[tuple], late: list[dict]) -> pd.DataFrame:
        names = ["dataset_id", *self.names(), "late"]
        blank = (None,) * (len(names) - 3)
        rows = [(key[0], *r, False) for r in out] + [(key[0], r["frame_count"], *blank, True) for r in late]
        return pd.DataFrame(rows, columns=names, dtype=object)

    def names(self) -> list[str]:
        return [f.split(" ")[0] for f in self.fields.split(", ")]  # a worker has no session to parse types

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        names = self.rows.names
        new = [dict(zip(names, (None if v is None or v != v else v for v in r), strict=True)) for part in rows for r in part[names].itertuples(index=False, name=None)]
        mark = self.mark.get()  # each call on a state is a trip to the state server, so a new flight makes no other
        released, seen = mark or (NEVER, NEVER)
        late = [r for r in new if r["us"] <= released]
        wait = ([dict(zip(names, r, strict=True)) for r in self.pending.get()] if mark else []) + [r for r in new if r["us"] > released]
        before, seen = seen, max([seen, *(r["us"] for r in new)])
        upto = max(released, seen - self.delay)
        ready = sorted((r for r in wait if r["us"] <= upto), key=self.order)
        rest = [r for r in wait if r["us"] > upto]
        out: list[tuple] = []
        if ready:
            kept, out = self.step((self.kept.get() if mark else None) or self.start(), ready)
            self.kept.update(kept)
        if rest:
            self.pending.put([tuple(r[n] for n in names) for r in rest])
        elif mark:
            self.pending.clear()
        self.mark.update((upto, seen))
        if seen > before:
            if before > NEVER:
                self.handle.deleteTimer(before // 1000 + 1)
            self.handle.registerTimer(seen // 1000 + 1)
        yield self._made(key, out, late)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        names = self.rows.names
        rest = sorted((dict(zip(names, r, strict=True)) for r in self.pending.get()), key=self.order)
        kept, out = self.step(self.kept.get() or self.start(), rest)
        out = out + self.finish(kept)
        for state in (self.pending, self.mark, self.kept):
            state.clear()
        yield self._made(key, out, [])

    @staticmethod
    def order(row: dict) -> tuple:
        return row["us"], row["frame_count"], row.get("rank", 0)

    def close(self) -> None:
        pass


def run_in_order(stream: DataFrame, loop: InOrder, gap_s: float, key_type: str = "long") -> DataFrame:
    """``stream`` (dataset_id, us long: event time in microseconds after 1970, and the loop's columns) through a loop.

    ``gap_s`` is to be ``delay_s`` at least, as Spark drops rows that its own watermark has passed.
    """
    spark = stream.sparkSession
    spark.conf.set(*STORE)
    timed = stream.select("dataset_id", F.timestamp_micros("us").alias("event_time"), *loop.rows.names).withWatermark("event_time", f"{int(gap_s * 1000)} milliseconds")
    return timed.groupBy("dataset_id").transformWithStateInPandas(loop, f"dataset_id {key_type}, {loop.fields}, late boolean", "Append", "EventTime")


def _schema(stream: DataFrame, names: str) -> T.StructType:
    return T.StructType([T.StructField(n, stream.schema[n].dataType) for n in ("us", "frame_count", *names.split())])


class Smoother:
    """Causal gap fill and Gaussian smoothing of one flight; keeps the positions that the window reads."""

    def __init__(self, half: int, lats: list[float], lons: list[float]):
        self.half, self.lats, self.lons = half, list(lats or []), list(lons or [])
        self.weights = [gauss(j, 0.6 * half) if half else 1.0 for j in range(2 * half + 1)]

    def push(self, lat: float | None, lon: float | None) -> tuple:
        """(filled_lat, filled_lon, smoothed_lat, smoothed_lon); nulls before the first position."""
        if lat is None or lon is None:
            if not self.lats:
                return (None,) * 4
            lat, lon = self.lats[-1], self.lons[-1]
        n = len(self.weights)
        self.lats, self.lons = [*self.lats, lat][-n:], [*self.lons, lon][-n:]
        return lat, lon, *self.now()

    def now(self) -> tuple[float | None, float | None]:
        used = self.weights[: len(self.lats)]
        mean = lambda v: sum(w * x for w, x in zip(used, reversed(v), strict=True)) / sum(used)
        return (mean(self.lats), mean(self.lons)) if self.lats else (None, None)


class FillAndSmooth(InOrder):
    fields = "frame_count long, filled_lat double, filled_lon double, smoothed_lat double, smoothed_lon double"
    memory = "lats array<double>, lons array<double>"

    def __init__(self, rows: T.StructType, delay_s: float, half: int):
        super().__init__(rows, delay_s)
        self.half = half

    def start(self) -> tuple:
        return [], []

    def step(self, kept: tuple, rows: list[dict]) -> tuple[tuple, list[tuple]]:
        s = Smoother(self.half, *kept)
        out = [(r["frame_count"], *s.push(r["raw_lat"], r["raw_lon"])) for r in rows]
        return (s.lats, s.lons), out


def localise_unordered(fixes: DataFrame, delay_s: float, gap_s: float, half: int = 4) -> DataFrame:
    """The causal loop over a stream of fixes (dataset_id, frame_count, us, raw_lat, raw_lon) in any order of arrival."""
    return run_in_order(fixes, FillAndSmooth(_schema(fixes, "raw_lat raw_lon"), delay_s, half), gap_s)


#: (row, centre_lat, centre_lon) -> (status, inliers, lat, lon); and row -> (inliers, ratio, lat, lon).
SatelliteSearch = Callable[[dict, float, float], tuple[str, int, float | None, float | None]]
FrameSearch = Callable[[dict], tuple[int, float, float | None, float | None]]


class LiveLoop(InOrder):
    """Satellite search around the loop's own position; where that fails, retrieval; then fill, smooth, and feed back."""

    fields = (
        "frame_count long, sat_status string, sat_inliers int, centre_lat double, centre_lon double, vpr_triggered boolean, vpr_inliers int, vpr_ratio double, source string, "
        "raw_final_lat double, raw_final_lon double, smoothed_lat double, smoothed_lon double, satellite_calls long, retrieval_calls long"
    )
    memory = "lats array<double>, lons array<double>, satellite_calls long, retrieval_calls long"

    def __init__(self, rows: T.StructType, delay_s: float, satellite: SatelliteSearch, retrieval: FrameSearch, live: Live, camera: Projection):
        super().__init__(rows, delay_s)
        self.satellite, self.retrieval, self.live, self.camera = satellite, retrieval, live, camera

    def start(self) -> tuple:
        return [], [], 0, 0

    def centre(self, row: dict, lat: float, lon: float) -> tuple[float, float]:
        """Where to search: the own position, moved to where the camera looks from there."""
        tangent = math.tan(math.radians(self.camera.camera_angle_deg))
        far = 0.0 if abs(tangent) < 1e-6 else row["rel_alt"] / tangent
        turn = math.radians(row["heading_deg"])
        return lat + far * math.cos(turn) / METRES_PER_DEGREE, lon + far * math.sin(turn) / (METRES_PER_DEGREE * math.cos(math.radians(lat)))

    def step(self, kept: tuple, rows: list[dict]) -> tuple[tuple, list[tuple]]:
        s, (sat_calls, vpr_calls) = Smoother(self.live.half_window, *kept[:2]), kept[2:]
        out = []
        for row in rows:
            at, (lat, lon) = (None, None), s.now()
            status, inliers, raw, source = "no_position_yet" if lat is None else "low_alt", 0, (None, None), None
            if lat is not None and row["rel_alt"] is not None and row["rel_alt"] >= self.live.min_altitude_m:
                status = "no_heading_yet"
                if row["heading_deg"] is not None:
                    at = self.centre(row, lat, lon)
                    sat_calls += 1
                    status, inliers, *raw = self.satellite(row, *at)
            vpr = (0, 0.0)
            if status == "ok":
                source = "SAT"
            else:
                vpr_calls += 1
                *vpr, vpr_lat, vpr_lon = self.retrieval(row)
                good = vpr[0] >= self.live.vpr_inliers and vpr[1] >= self.live.vpr_ratio
                source, raw = ("VPR_FALLBACK", (vpr_lat, vpr_lon)) if good else ("NO_FIX", (None, None))
            smoothed = s.push(*raw)[2:]
            out.append((row["frame_count"], status, int(inliers), *at, source != "SAT", int(vpr[0]), round(float(vpr[1]), 3), source, *raw, *smoothed, sat_calls, vpr_calls))
        return (s.lats, s.lons, sat_calls, vpr_calls), out


def live_loop(frames: DataFrame, satellite: SatelliteSearch, retrieval: FrameSearch, columns: str = "", delay_s: float = 0.0, gap_s: float = 60.0, live: Live = Live(), camera: Projection = Projection()) -> DataFrame:
    """The feedback loop on a stream of frames (dataset_id, frame_count, us, rel_alt, heading_deg and ``columns``).

    The satellite search is called with the flight's own smoothed position, moved by the camera's offset, and only where
    there is a position, enough altitude and a heading; retrieval is called only for frames without a satellite fix. So a
    flight is sequential and one task's; flights are independent. ``satellite_calls`` and ``retrieval_calls`` count the
    calls of a flight so far. A provider is any callable that pickles; rows are dicts of the named columns.
    """
    rows = _schema(frames, f"rel_alt heading_deg {columns}")
    return run_in_order(frames, LiveLoop(rows, delay_s, satellite, retrieval, live, camera), gap_s)


class FixedLag(InOrder):
    """Second-order decoding that decides a frame when ``lag`` more are known; see ``OnlineDecoder``."""

    fields = "frame_count long, step long, rank int"
    memory = OnlineDecoder.STATE + ", frames array<long>, ranks array<array<int>>"

    def __init__(self, rows: T.StructType, delay_s: float, lag: int, cfg: Costs):
        super().__init__(rows, delay_s)
        self.lag, self.cfg = lag, cfg

    def start(self) -> tuple:
        return (*OnlineDecoder(self.lag, self.cfg).state(), [], [])

    def _decided(self, first: int, chosen: list[int], frames: list[int], ranks: list[list[int]]) -> list[tuple]:
        out = [(frames[k], first + k, ranks[k][c]) for k, c in enumerate(chosen)]
        del frames[: len(chosen)], ranks[: len(chosen)]
        return out

    def step(self, kept: tuple, rows: list[dict]) -> tuple[tuple, list[tuple]]:
        decoder = OnlineDecoder.of(self.lag, self.cfg, kept[:-2])
        frames, ranks, out = list(kept[-2]), [list(r) for r in kept[-1]], []
        at = 0
        while at < len(rows):
            upto = at
            while upto < len(rows) and rows[upto]["frame_count"] == rows[at]["frame_count"]:
                upto += 1
            own = rows[at:upto]
            first = decoder.decided
            frames.append(own[0]["frame_count"])
            ranks.append([r["rank"] for r in own])
            out += self._decided(first, decoder.push([r["unary"] for r in own], [(r["x_m"], r["y_m"]) for r in own]), frames, ranks)
            at = upto
        return (*decoder.state(), frames, ranks), out

    def finish(self, kept: tuple) -> list[tuple]:
        decoder = OnlineDecoder.of(self.lag, self.cfg, kept[:-2])
        first = decoder.decided
        return self._decided(first, decoder.finish(), list(kept[-2]), [list(r) for r in kept[-1]])


def decode_stream(candidates: DataFrame, lag: int, delay_s: float, gap_s: float, cfg: Costs = Costs()) -> DataFrame:
    """Fixed-lag decoding of a stream of candidates (dataset_id string, frame_count, us, rank int, unary, x_m, y_m).

    The candidates of a frame share its time; steps are the frames of a flight in order. What is left of a flight when it
    ends is decided then.
    """
    return run_in_order(candidates, FixedLag(_schema(candidates, "rank unary x_m y_m"), delay_s, lag, cfg), gap_s, "string")
