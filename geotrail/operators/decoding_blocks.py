"""Viterbi decoding of one flight by many tasks: blocks of time as matrices over (min, +).

A path's cost is a sum, and the cheapest way through a block from each state at its beginning to each state at its end is
a matrix; matrices of neighbouring blocks combine by (min, +). So blocks are reduced to matrices side by side, a short
scan over matrices gives the costs with which each block begins, blocks then decode from those side by side and say from
which state each of their last states comes, a scan backwards over these maps gives each block's last state, and blocks
trace their own paths. A state is a candidate (first order) or a pair of candidates of neighbouring frames (second order).

Costs are the same sums as in the sequential decoder, taken in another order: paths are equal, ties included, where the
sums are exact; where rounding makes the difference between two paths, either may come out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Costs
from ..sources.scratch import written
from .decoding import _bend, _step, first_order
from .sequence import FLIGHT

#: Steps of a block.
BLOCK = 4096


def _frames(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    rows = rows.sort_values(["step", "rank"])
    steps, at = np.unique(rows["step"].to_numpy(), return_index=True)
    cut = lambda v: np.split(v, at[1:])
    return steps, cut(rows["unary"].to_numpy()), cut(rows[["x_m", "y_m"]].to_numpy()), cut(rows["rank"].to_numpy())


class Block:
    """The frames of one block behind the last frames of the one before (one a order), which give the states it begins with."""

    def __init__(self, rows: pd.DataFrame, block: int, length: int, order: int, cfg: Costs):
        self.steps, self.unary, self.xy, self.ranks = _frames(rows)
        self.order, self.cfg = order, cfg
        self.first = block == 0
        self.held = 0 if self.first else int((self.steps < block * length).sum())

    def begin(self) -> tuple[np.ndarray, int]:
        """Costs of the states at the beginning of a flight, and the place of the next frame."""
        if self.order == 1:
            return self.unary[0], 1
        return self.unary[0][:, None] + self.unary[1][None, :] + _step(self.xy[0], self.xy[1], self.cfg), 2

    def advance(self, cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Costs with the frame at ``k``, and where each state comes from; leading axes of ``cost`` are kept."""
        move = _step(self.xy[k - 1], self.xy[k], self.cfg) + self.unary[k][None, :]
        if self.order == 1:
            total = cost[..., :, None] + move
            return total.min(axis=-2), total.argmin(axis=-2)
        total = cost[..., :, :, None] + (move[None] + _bend(self.xy[k - 2], self.xy[k - 1], self.xy[k], self.cfg))
        return total.min(axis=-3), total.argmin(axis=-3)

    def width(self) -> tuple[int, ...]:
        """The shape of the states that it begins with."""
        return tuple(len(u) for u in self.unary[self.held - self.order : self.held])

    def matrix(self) -> np.ndarray:
        """Costs from each beginning state (or from the flight's beginning) to each last state."""
        if self.first:
            cost, k = self.begin()
        else:
            n = int(np.prod(self.width()))
            cost = np.where(np.eye(n, dtype=bool), 0.0, np.inf).reshape(n, *self.width())
            k = self.held
        for at in range(k, len(self.steps)):
            cost, _ = self.advance(cost, at)
        return cost.reshape(1 if self.first else cost.shape[0], -1)

    def parents(self, entry: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """The last costs, and where each state of each frame comes from, from the costs of the beginning states."""
        cost, k = self.begin() if self.first else (entry.reshape(self.width()), self.held)
        back = []
        for at in range(k, len(self.steps)):
            cost, came = self.advance(cost, at)
            back.append(came)
        return cost, back

    def origins(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last costs, and the beginning state of the cheapest way to each last state."""
        cost, origin = entry.reshape(self.width()), np.arange(entry.size).reshape(self.width())
        for at in range(self.held, len(self.steps)):
            cost, came = self.advance(cost, at)
            origin = origin[came] if self.order == 1 else origin[came, np.arange(came.shape[0])[:, None]]
        return cost, origin

    def alone(self) -> bool:
        """A flight of fewer than three frames, which second order leaves to the first."""
        return self.order == 2 and self.first and len(self.steps) < 3

    def trace(self, back: list[np.ndarray], last: int, shape: tuple[int, ...]) -> list[int]:
        """Choices of the block's own frames on the way to the state ``last``."""
        state = np.unravel_index(last, shape)
        found = [int(s) for s in reversed(state)]
        for came in reversed(back):
            found.append(int(came[tuple(reversed(found[-self.order :]))]))
        found.reverse()
        return found if self.first else found[self.order :]


def decode_blocks(candidates: DataFrame, order: int = 1, cfg: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """(dataset_id, step, rank) like ``decoding.decode``; flights have names, and their steps are numbered from 0 without gaps.

    A task holds one block of frames and, in the two scans, a matrix or a map a block of one flight. With second order a
    block has three frames at least, so the last one may take up to two more.
    """
    block = max(block, order + 1)
    slim = candidates.select(FLIGHT, F.col("step").cast("long").alias("step"), F.col("rank").cast("int").alias("rank"), "unary", "x_m", "y_m")
    steps = slim.groupBy(FLIGHT).agg(F.max("step").alias("__last"))
    # a rest of no more frames than a state has belongs to the block before it
    blocks = F.greatest(F.lit(1), F.floor((F.col("__last") + 1 - (order + 1)) / block) + 1)
    own = F.least(F.floor(F.col("step") / block), F.col("__blocks") - 1)
    dealt = slim.join(steps, FLIGHT).withColumn("__blocks", blocks).withColumn("block", own.cast("long"))
    inside = F.array(F.col("block"))
    shown = F.when((F.pmod(F.col("step"), F.lit(block)) >= block - order) & (F.col("block") + 1 < F.col("__blocks")), F.array(F.col("block"), F.col("block") + 1)).otherwise(inside)
    rows = written(dealt.withColumn("block", F.explode(shown)).drop("__last", "__blocks"))
    keys = [FLIGHT, "block"]

    def reduce_block(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        m = Block(own, key[1], block, order, cfg)
        made = np.zeros((1, 1)) if m.alone() else m.matrix()
        return pd.DataFrame({FLIGHT: [key[0]], "block": [key[1]], "rows": [made.shape[0]], "cells": [made.ravel().tolist()]})

    matrices = written(rows.groupBy(*keys).applyInPandas(reduce_block, f"{FLIGHT} string, block long, rows int, cells array<double>"))

    def scan(flight: pd.DataFrame) -> pd.DataFrame:
        flight = flight.sort_values("block")
        cost, entries = None, []
        for n, cells in zip(flight["rows"], flight["cells"], strict=True):
            entries.append([] if cost is None else cost.tolist())
            m = np.asarray(cells, float).reshape(n, -1)
            cost = m[0] if cost is None else (cost[:, None] + m).min(axis=0)
        return pd.DataFrame({FLIGHT: flight[FLIGHT].to_numpy(), "block": flight["block"].to_numpy(), "entry": entries})

    entries = written(matrices.groupBy(FLIGHT).applyInPandas(scan, f"{FLIGHT} string, block long, entry array<double>"))

    def ways(key: tuple, own: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        m = Block(own, key[1], block, order, cfg)
        if m.alone():
            best, came = 0, np.zeros(1, int)
        elif m.first:
            cost = m.matrix()
            best, came = int(cost.argmin()), np.zeros(cost.size, int)
        else:
            cost, came = m.origins(np.asarray(entry["entry"].iloc[0], float))
            best = int(cost.argmin())
        return pd.DataFrame({FLIGHT: [key[0]], "block": [key[1]], "best": [best], "came": [came.ravel().tolist()]})

    maps = written(rows.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(ways, f"{FLIGHT} string, block long, best int, came array<int>"))

    def back_scan(flight: pd.DataFrame) -> pd.DataFrame:
        flight = flight.sort_values("block", ascending=False)
        state, out = int(flight["best"].iloc[0]), []
        for came in flight["came"]:
            out.append(state)
            state = int(came[state])
        return pd.DataFrame({FLIGHT: flight[FLIGHT].to_numpy(), "block": flight["block"].to_numpy(), "last": out})

    lasts = maps.groupBy(FLIGHT).applyInPandas(back_scan, f"{FLIGHT} string, block long, last int")
    both = entries.join(lasts, keys)

    def paths(key: tuple, own: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        m = Block(own, key[1], block, order, cfg)
        last = int(entry["last"].iloc[0])
        if m.alone():
            chosen = first_order(m.unary, m.xy, cfg)
        else:
            cost, back = m.parents(np.asarray(entry["entry"].iloc[0], float))
            chosen = m.trace(back, last, cost.shape)
        steps, ranks = m.steps[m.held :], m.ranks[m.held :]
        return pd.DataFrame({FLIGHT: key[0], "step": steps, "rank": [int(r[c]) for r, c in zip(ranks, chosen, strict=True)]})

    return rows.groupBy(*keys).cogroup(both.groupBy(*keys)).applyInPandas(paths, f"{FLIGHT} string, step long, rank int")
