"""Exact retrieval over cells: balls around pivots, of which a query multiplies only those that can hold one of its best.

References belong to their nearest pivot; a cell's ball has the radius of its farthest member. For a query ``q`` no member
of a cell with centre ``c`` and radius ``r`` is more similar than ``q.c + |q| r``. A query first multiplies the cells of
the highest bounds until they hold ``k`` references; its k-th best similarity then rules out all cells with lower bounds,
and only the rest are multiplied. Results equal those over all pairs; how many pairs that takes depends on how far the
descriptors cluster, and is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Pivots, and references that they are fitted on; both bound what the driver holds and tasks are sent.
PIVOTS, FIT = 1024, 16384
ROUNDS = 5
#: Relative slack of a bound over the rounding of a product.
SLACK = 1e-9
QUERY_BLOCK, REFERENCE_SHARD = 1024, 16384
#: Queries and references whose products are held at once, and pairs that are multiplied alone at once.
TILE_ROWS, TILE_REFS, PIECE = 256, 4096, 1 << 12
#: References whose products give the first floor of a row.
PROBE = 512


class Found(NamedTuple):
    """``tops`` (q, r, sim, rank), and ``work`` (q, pairs): how many references each query was multiplied with."""

    tops: DataFrame
    work: DataFrame


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    parts = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    if not parts:
        return np.zeros((0, 0))
    if any(c.null_count for c in parts) or len({n for c in parts for n in np.unique(pc.list_value_length(c).to_numpy(zero_copy_only=False)).tolist()}) > 1:
        return np.stack([np.asarray(v.values, np.float64) for c in parts for v in c])  # which says what is wrong with them
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.float64) for c in parts])


def _exact(x: np.ndarray, refs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of pairs, each alone: equal vectors then have equal products, wherever they stand."""
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[p : p + PIECE]], refs[j[p : p + PIECE]]) for p in range(0, len(i), PIECE))])


def _nonzero(flags: np.ndarray) -> np.ndarray:
    """Places of the few set bytes; ``flags`` has a length that 8 divides."""
    words = np.flatnonzero(flags.view(np.uint64))
    w, at = np.nonzero(flags.reshape(-1, 8)[words])
    return words[w] * 8 + at


def largest(x: np.ndarray, refs: np.ndarray, order: np.ndarray, k: int, allowed: Callable[[slice, slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sim): of each row ``i`` of ``x`` the ``k`` rows ``j`` of ``refs`` with the largest products, ties to the higher ``order``.

    Products are taken a tile at a time, in single precision. ``slack`` bounds their error, so what lies more than twice
    that below a row's k-th best so far is none of its best, and nearly all are passed over by one comparison. What is
    left in the end is multiplied anew in double precision. ``allowed`` masks the pairs of a tile.
    """
    width, found = x.shape[1], [[], [], []]
    own, others = np.sqrt((x**2).sum(axis=1)), np.sqrt((refs**2).sum(axis=1))
    odd = not (np.isfinite(own).all() and np.isfinite(others).all())  # products that are no numbers come last
    others = np.max(others[np.isfinite(others)], initial=0.0)
    single = not odd and max(np.max(own, initial=0.0), others) < 1e15
    a, b = (x.astype(np.float32), refs.astype(np.float32)) if single else (x, refs)
    with np.errstate(invalid="ignore", over="ignore"):
        # rounding of ``width`` sums of products and of both factors, and numbers too small for single precision
        slack = 2 * ((width + 4) * 2.0**-23 * own * others + width * 2.0**-125 * (1 + own + others)) if single else 2 * SLACK * own * others
    slack = np.where(np.isfinite(slack), slack, 0.0)
    products = np.empty(TILE_ROWS * TILE_REFS, a.dtype)
    flags = np.zeros(-(-TILE_ROWS * TILE_REFS // 8) * 8, np.uint8)
    for at in range(0, len(x), TILE_ROWS):
        rows = slice(at, min(len(x), at + TILE_ROWS))
        n, off = rows.stop - at, slack[rows]
        floor = np.full(n, -np.inf)
        i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def best(i: np.ndarray, j: np.ndarray, at: int = at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sim = _exact(x, refs, at + i, j)
            by = np.lexsort((-order[j], -sim, i))
            i, j, sim = i[by], j[by], sim[by]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            return i[top], j[top], sim[top]

        for first in range(0, len(refs), TILE_REFS):
            cols = slice(first, min(len(refs), first + TILE_REFS))
            m = cols.stop - first
            tile, reach = products[: n * m].reshape(n, m), flags[: n * m].view(bool).reshape(n, m)
            np.matmul(a[rows], b[cols].T, out=tile)
            mask = None if allowed is None else allowed(rows, cols)
            if mask is not None:
                tile[~mask] = -np.inf
            if odd:
                tile[np.isnan(tile)] = -np.inf
            some = tile[:, : max(PROBE, 4 * k)]
            if not first and some.shape[1] > k:
                floor = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k].astype(np.float64)
            least = floor - off
            np.greater_equal(tile, (np.nextafter(least.astype(np.float32), np.float32(-np.inf)) if single else least)[:, None], out=reach)
            if mask is not None:
                reach &= mask
            used = -(-n * m // 8) * 8
            flags[n * m : used] = 0
            new = _nonzero(flags[:used])
            if not len(new):
                continue
            i, j, s = np.concatenate([i, new // m]), np.concatenate([j, first + new % m]), np.concatenate([s, products[new]])
            by = np.lexsort((-s, i))
            i, j, s = i[by], j[by], s[by]
            full = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
            floor[i[full]] = s[full]
            keep = s >= (floor - off)[i]
            i, j, s = i[keep], j[keep], s[keep]
            if len(i) > 4 * k * n + PIECE:  # very many equal or nearly equal ones
                i, j, s = best(i, j)
                s = np.where(np.isnan(s), -np.inf, s)
        i, j, s = best(i, j)
        for out, c in zip(found, (at + i, j, s), strict=True):
            out.append(c)
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True))


def fit_pivots(refs: DataFrame, n: int) -> np.ndarray:
    """Up to ``n`` centres: k-means in the driver over a sample of at most FIT references, those of the least digests."""
    sample = refs.select("v").orderBy(F.xxhash64("r"), "r").limit(FIT).toArrow()
    x = matrix(sample["v"])
    centres = x[: min(n, max(1, int(np.sqrt(len(x)) * 4)))].copy()
    for _ in range(ROUNDS if len(x) > len(centres) else 0):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)


def _appended(df: DataFrame, kernel, fields: str) -> DataFrame:
    """Arrow rows of ``df`` with columns that ``kernel`` gives for each batch."""
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([*part.columns, *kernel(part)], names=[*part.schema.names, *new.names])

    return df.mapInArrow(run, T.StructType([*df.schema, *new]))


def assigned(refs: DataFrame, centres: np.ndarray) -> DataFrame:
    """``refs`` with their ``cell`` and the distance to its centre."""
    sent = refs.sparkSession.sparkContext.broadcast(centres)

    def kernel(batch: pa.RecordBatch) -> list:
        x = matrix(batch.column(batch.schema.get_field_index("v")))
        own = nearest(x, sent.value)
        far = np.sqrt(((x - sent.value[own]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)
        return [pa.array(own, pa.int32()), pa.array(far, pa.float64())]

    return _appended(refs, kernel, "cell int, far double")


def _visits(queries: DataFrame, centres: np.ndarray, cells: dict[int, tuple[int, float]], k: int, first: bool) -> DataFrame:
    """``queries`` once for each cell to multiply: the first ones, or those that ``floor`` leaves of the others."""
    ids = np.array(sorted(cells), np.int64)
    count, radius = np.array([cells[i][0] for i in ids.tolist()], np.int64), np.array([cells[i][1] for i in ids.tolist()], np.float64)
    sent = queries.sparkSession.sparkContext.broadcast((ids, centres[ids] if len(ids) else centres[:0], count, radius))

    def kernel(batch: pa.RecordBatch) -> list:
        own, c, n, r = sent.value
        x = matrix(batch.column(batch.schema.get_field_index("v")))
        if not len(own):
            return [pa.array([[] for _ in range(batch.num_rows)], pa.list_(pa.int32()))]
        norm = np.sqrt((x**2).sum(axis=1))
        bound = x @ c.T + norm[:, None] * r
        bound += SLACK * (norm[:, None] * (np.sqrt((c**2).sum(axis=1)) + r) + 1e-300)
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(n[order], axis=1)
        began = held - n[order] < k  # the cells before hold fewer than k
        out = []
        floor = None if first else batch.column(batch.schema.get_field_index("floor")).to_numpy(zero_copy_only=False)
        for i in range(len(x)):
            if first:
                out.append(own[order[i][began[i]]].tolist())
            else:
                rest = order[i][~began[i]]
                out.append(own[rest[bound[i][rest] >= floor[i]]].tolist())
        return [pa.array(out, pa.list_(pa.int32()))]

    return _appended(queries, kernel, "cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def _multiplied(visits: DataFrame, refs: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(q, r, sim, ord): of each query and shard of a cell the best ``k``. Cells are cut into shards, their visitors into blocks."""
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    shape = sizes.join(asked, "cell").select("cell", "blocks", F.ceil(F.col("n") / REFERENCE_SHARD).cast("int").alias("shards"))
    shape, again = F.broadcast(shape), F.broadcast(shape.toDF("cell", "r_blocks", "r_shards"))  # a row a cell
    qs = visits.select("q", "v", "cell").join(shape, "cell").withColumn("b", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rs = refs.select("r", "v", "ord", "cell").join(again, "cell").withColumn("s", F.pmod(F.xxhash64("r"), F.col("r_shards")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
    qs, rs = qs.select("cell", "s", "b", "q", "v"), rs.select("cell", "s", "b", "r", "v", "ord")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        order, keys, names = b["ord"].to_numpy(), b["r"].to_numpy(), a["q"].to_numpy()
        i, j, sim = largest(matrix(a["v"]), matrix(b["v"]), order, k) if a.num_rows and b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(x, t) for x, t in zip((names[i], keys[j], sim, order[j]), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["q", "r", "sim", "ord"])

    return qs.groupBy("cell", "s", "b").cogroup(rs.groupBy("cell", "s", "b")).applyInArrow(best, "q long, r long, sim double, ord long")


def search(queries: DataFrame, refs: DataFrame, k: int, pivots: int = PIVOTS) -> Found:
    """The ``k`` most similar references of each query, ties to the higher ``ord``.

    ``queries`` (q long, v array), ``refs`` (r long, v array, ord long), vectors of one length. No reference, no row. The
    driver holds pivots and a row a cell.
    """
    k = max(1, k)
    centres = fit_pivots(refs, pivots)
    if not len(centres):
        empty = queries.sparkSession.createDataFrame([], "q long, r long, sim double, rank int")
        return Found(empty, queries.select("q", F.lit(0).cast("long").alias("pairs")))
    dealt = written(assigned(refs.select("r", "v", "ord"), centres))
    sizes = written(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in sizes.collect()}
    w = Window.partitionBy("q").orderBy(F.desc("sim"), F.desc("ord"))
    best = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    slim = queries.select("q", "v")
    one = _visits(slim, centres, cells, k, True)
    near = written(best(_multiplied(one, dealt, sizes, k)))
    floors = near.groupBy("q").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(float("-inf")).alias("floor"))
    two = _visits(slim.join(floors, "q"), centres, cells, k, False)
    tops = written(best(near.drop("rank").unionByName(_multiplied(two, dealt, sizes, k))))  # or each use would multiply anew
    visits = one.select("q", "cell").unionByName(two.select("q", "cell")).join(F.broadcast(sizes), "cell")
    return Found(tops.select("q", "r", "sim", "rank"), visits.groupBy("q").agg(F.sum("n").alias("pairs")))
