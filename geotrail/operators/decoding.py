"""Sequence decoding over ranked candidates: first- and second-order Viterbi and its fixed-lag online form.

A step of a flight depends on the one before, so a flight is decoded by one task; flights are independent. Candidate
tables are a few rows per frame, whatever the size of the reference set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Costs
from ..functions import geo
from .sequence import FLIGHT


def with_unary(candidates: DataFrame, cfg: Costs = Costs()) -> DataFrame:
    return candidates.withColumn("unary", geo.unary_cost("sim", "lg_inlier_count", "lg_inlier_ratio", (cfg.similarity_weight, cfg.inlier_weight, cfg.ratio_weight)))


def pair_costs(candidates: DataFrame, cfg: Costs = Costs()) -> DataFrame:
    """Step costs between all candidates of consecutive frames, an equi-join on the step number."""
    a = candidates.select(FLIGHT, (F.col("step") + 1).alias("step"), F.col("rank").alias("prev_rank"), F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    both = candidates.join(a, [FLIGHT, "step"])
    return both.withColumn("step_cost", geo.step_cost(geo.length(F.col("x_m") - F.col("px"), F.col("y_m") - F.col("py")), cfg.max_step_m, cfg.transition_weight)).select(FLIGHT, "step", "prev_rank", "rank", "step_cost")


def _step(a: np.ndarray, b: np.ndarray, cfg: Costs) -> np.ndarray:
    far = np.sqrt(((b[None, :, :] - a[:, None, :]) ** 2).sum(-1))
    return cfg.transition_weight * (np.maximum(0.0, far - cfg.max_step_m) / max(cfg.max_step_m, 1e-6)) ** 2


def _bend(o: np.ndarray, p: np.ndarray, q: np.ndarray, cfg: Costs) -> np.ndarray:
    """Acceleration and turn costs of (older, previous, current)."""
    first, second = (p[None, :, :] - o[:, None, :])[:, :, None, :], (q[None, :, :] - p[:, None, :])[None]
    jerk = np.sqrt(((second - first) ** 2).sum(-1))
    cost = cfg.acceleration_weight * (jerk / max(cfg.acceleration_scale_m, 1e-6)) ** 2
    if cfg.direction_weight > 0:
        n1, n2 = np.sqrt((first**2).sum(-1)), np.sqrt((second**2).sum(-1))
        with np.errstate(invalid="ignore", divide="ignore"):
            turn = np.degrees(np.arccos(np.clip((first * second).sum(-1) / (n1 * n2), -1, 1)))
        short = (n1 < cfg.min_direction_step_m) | (n2 < cfg.min_direction_step_m)
        cost = cost + np.where(short, 0.0, cfg.direction_weight * (turn / max(cfg.direction_scale_deg, 1e-6)) ** 2)
    return cost


def first_order(unary: list[np.ndarray], xy: list[np.ndarray], cfg: Costs) -> list[int]:
    """The cheapest path; of equal costs the lowest candidate."""
    cost, parents = unary[0], []
    for k in range(1, len(unary)):
        total = cost[:, None] + unary[k][None, :] + _step(xy[k - 1], xy[k], cfg)
        parents.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    path = [int(cost.argmin())]
    for p in reversed(parents):
        path.append(int(p[path[-1]]))
    return path[::-1]


class OnlineDecoder:
    """Second-order Viterbi, a frame at a time. With ``lag`` a frame is decided once ``lag`` more are known and stays so.

    It holds the costs of the pairs of the last two frames, their places, and the parents of the last ``lag - 1`` steps
    (all without a lag), so a step costs the same however long the flight is. Flights of fewer than three frames are
    decoded in first order where nothing is decided before they end.
    """

    STATE = "seen long, decided long, unary array<array<double>>, xs array<array<double>>, ys array<array<double>>, cost array<array<double>>, parents array<array<array<int>>>"

    def __init__(self, lag: int | None, cfg: Costs):
        self.lag, self.cfg = lag, cfg
        self.seen, self.decided = 0, 0
        self.unary: list[np.ndarray] = []
        self.xy: list[np.ndarray] = []
        self.cost = np.zeros((0, 0))
        self.parents: list[np.ndarray] = []

    @classmethod
    def of(cls, lag: int | None, cfg: Costs, state: tuple) -> OnlineDecoder:
        d = cls(lag, cfg)
        d.seen, d.decided, unary, xs, ys, cost, parents = state
        d.unary, d.xy = [np.array(u, float) for u in unary], [np.column_stack([x, y]) for x, y in zip(xs, ys, strict=True)]
        d.cost, d.parents = np.array([list(r) for r in cost], float), [np.array([list(r) for r in p], int) for p in parents]
        return d

    def state(self) -> tuple:
        return (
            self.seen, self.decided, [u.tolist() for u in self.unary], [p[:, 0].tolist() for p in self.xy], [p[:, 1].tolist() for p in self.xy], self.cost.tolist(), [p.tolist() for p in self.parents],
        )

    def push(self, unary, xy) -> list[int]:
        """Takes the candidates of the next frame; gives the choices for the frames that this decides, from ``decided`` on."""
        unary, xy = np.asarray(unary, float), np.asarray(xy, float)
        if self.seen == 1:
            self.cost = self.unary[0][:, None] + unary[None, :] + _step(self.xy[0], xy, self.cfg)
        elif self.seen > 1:
            total = self.cost[:, :, None] + unary[None, None, :] + _step(self.xy[1], xy, self.cfg)[None] + _bend(self.xy[0], self.xy[1], xy, self.cfg)
            self.parents.append(total.argmin(axis=0))
            self.cost = total.min(axis=0)
            if self.lag is not None:
                self.parents = self.parents[max(0, len(self.parents) - max(self.lag - 1, 0)) :]
        self.unary, self.xy = [*self.unary, unary][-2:], [*self.xy, xy][-2:]
        self.seen += 1
        return self._decide(self.seen - 1 - self.lag) if self.lag is not None and self.seen > 1 else []

    def _decide(self, upto: int) -> list[int]:
        if upto < self.decided:
            return []
        a, b = np.unravel_index(int(self.cost.argmin()), self.cost.shape)
        found = [int(b), int(a)]
        for p in reversed(self.parents):
            if len(found) >= self.seen - self.decided:
                break
            found.append(int(p[found[-1], found[-2]]))
        out = found[::-1][max(0, len(found) - (self.seen - self.decided)) :][: upto + 1 - self.decided]
        self.decided = upto + 1
        return out

    def finish(self) -> list[int]:
        """Choices for the frames that are left."""
        if self.seen < 3 and not self.decided:
            return first_order(self.unary, self.xy, self.cfg) if self.seen else []
        return self._decide(self.seen - 1)


def second_order(unary: list[np.ndarray], xy: list[np.ndarray], cfg: Costs, lag: int | None = None) -> list[int]:
    """Viterbi over pairs, at once or with a fixed lag."""
    if len(unary) < 3:
        return first_order(unary, xy, cfg)
    decoder = OnlineDecoder(lag, cfg)
    return [k for u, p in zip(unary, xy, strict=True) for k in decoder.push(u, p)] + decoder.finish()


def decode(candidates: DataFrame, order: int = 1, cfg: Costs = Costs(), lag: int | None = None) -> DataFrame:
    """(dataset_id, step, rank): the chosen candidate of each frame.

    ``candidates``: dataset_id, step, rank, unary, x_m, y_m, with consecutive steps. Empty flights give no row.
    """

    def run(flight: pd.DataFrame) -> pd.DataFrame:
        flight = flight.sort_values(["step", "rank"])
        groups = [g for _, g in flight.groupby("step", sort=True)]
        unary, xy = [g["unary"].to_numpy() for g in groups], [g[["x_m", "y_m"]].to_numpy() for g in groups]
        path = first_order(unary, xy, cfg) if order == 1 else second_order(unary, xy, cfg, lag)
        return pd.DataFrame({FLIGHT: flight[FLIGHT].iloc[0], "step": [g["step"].iloc[0] for g in groups], "rank": [int(g["rank"].iloc[i]) for g, i in zip(groups, path, strict=True)]})

    slim = candidates.select(FLIGHT, F.col("step").cast("long").alias("step"), F.col("rank").cast("int").alias("rank"), "unary", "x_m", "y_m")
    return slim.groupBy(FLIGHT).applyInPandas(run, f"{FLIGHT} string, step long, rank int")


def numbered_steps(candidates: DataFrame, frame: str = "q") -> DataFrame:
    """``step``: dense number of the query frame in its flight, from 0."""
    return candidates.withColumn("step", F.dense_rank().over(Window.partitionBy(FLIGHT).orderBy(frame)).cast("long") - 1)


def improvement_counts(results: DataFrame, before: str, after: str) -> DataFrame:
    b, a = F.col(before), F.col(after)
    return results.agg(F.count("*").alias("queries"), F.count_if(a < b).alias("improved"), F.count_if(a > b).alias("worsened"), (F.count("*") - F.count_if(a < b) - F.count_if(a > b)).alias("unchanged"))
