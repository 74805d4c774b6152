"""Retrieval of reference frames by descriptor similarity, in blocks of queries against shards of references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, stats
from ..sources import scratch
from . import retrieval_index, scans

#: Queries and references that one task multiplies at once.
QUERY_BLOCK, REFERENCE_SHARD = 16384, 65536
#: Tasks that the cells of blocks and shards are dealt to, at most.
MOST_TASKS = 4096


def similarity(a: str, b: str) -> Column:
    """Dot product in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: str) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def _cell(k: int, max_gap_s: float | None):
    def best(queries: pa.Table, refs: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], []]
        if queries.num_rows and refs.num_rows:
            x, y, order = retrieval_index.matrix(queries["q_v"]), retrieval_index.matrix(refs["r_v"]), refs["ord"].to_numpy()
            names, keys = queries["q"].to_numpy(), refs["r"].to_numpy()
            t_q, t_r = queries["q_t"].to_numpy(), refs["r_t"].to_numpy()
            masks = [(True, None)]
            if max_gap_s:
                masks = [(False, None), (True, lambda a, b: np.abs(t_r[None, b] - t_q[a, None]) <= max_gap_s)]
            for allowed, mask in masks:
                i, j, sim = retrieval_index.largest(x, y, order, k, mask)
                for col, c in zip(rows, (names[i], keys[j], sim, order[j], np.full(len(i), allowed)), strict=True):
                    col.append(c)
        made = [np.concatenate(c) if c else [] for c in rows]
        return pa.table([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], names=["q", "r", "sim", "ord", "allowed"])

    return best


def top_references(queries: DataFrame, refs: DataFrame, k: int, max_gap_s: float | None = None) -> DataFrame:
    """(q, r, sim, rank): the ``k`` most similar references of each query, ties to the later reference.

    ``queries`` (q long, v array, t double), ``refs`` (r long, v array, t double, ord long). With ``max_gap_s`` only
    references that close in time count, unless a query has none. Each block of queries meets each shard of references
    in a task of bounded size and leaves its best ``k``; a query moves once a shard, a reference once a block. The rows
    are written once, so that what is built on them several times does not search again. For descriptors that cluster
    ``retrieval_index.search`` gives the same rows from fewer pairs.
    """
    k = max(1, k)
    blocks, shards = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-refs.count() // REFERENCE_SHARD))
    # names of their own: sides that come from one table would share the columns, and one of them would lose them
    queries, refs = queries.select("q", F.col("v").alias("q_v"), F.col("t").alias("q_t")), refs.select("r", F.col("v").alias("r_v"), F.col("t").alias("r_t"), "ord")
    qs = queries.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rs = refs.withColumn("s", F.pmod(F.xxhash64("r"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    n = min(2 * blocks * shards, MOST_TASKS)  # by number: a cell is a few MB, but seconds of work
    qs, rs = qs.repartition(n, "b", "s"), rs.repartition(n, "b", "s")
    met = qs.groupBy("b", "s").cogroup(rs.groupBy("b", "s")).applyInArrow(_cell(k, max_gap_s), "q long, r long, sim double, ord long, allowed boolean")
    if max_gap_s:
        met = met.withColumn("use", F.max("allowed").over(Window.partitionBy("q"))).where("allowed = use")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), F.desc("ord"))
    tops = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scratch.written(tops.select("q", "r", "sim", "rank"))


def located(tops: DataFrame, frames: DataFrame, lat0: float | Column, lon0: float | Column) -> DataFrame:
    """Candidates with both ends' positions and the planar error of taking the reference's."""
    at = lambda p: frames.select(F.col("frame_count").alias(p), F.col("ground_latitude").alias(f"{p}_lat"), F.col("ground_longitude").alias(f"{p}_lon"), F.col("dataset_id").alias(f"{p}_dataset"))
    both = tops.join(at("q"), "q").join(at("r"), "r")
    return both.withColumn("error_m", geo.position_error("q_lat", "q_lon", "r_lat", "r_lon", lat0, lon0))


def retrieval_results(candidates: DataFrame) -> DataFrame:
    """The best reference of each query, its error, and the least error among its candidates."""
    best = F.min_by(F.struct("r", "r_dataset", "sim", "r_lat", "r_lon", "error_m"), "rank")
    return candidates.groupBy("q").agg(best.alias("b"), F.count("*").alias("top_k"), F.min("error_m").alias("oracle_top_k_error_m")).select(
        F.col("q").alias("query_frame_count"), F.col("b.r").alias("reference_frame_count"), F.col("b.r_dataset").alias("reference_dataset"), F.col("b.sim").alias("similarity"),
        "top_k", "oracle_top_k_error_m", F.col("b.r_lat").alias("estimated_ground_latitude"), F.col("b.r_lon").alias("estimated_ground_longitude"), F.col("b.error_m").alias("position_error_m"))


def retrieval_summary(results: DataFrame) -> DataFrame:
    """Mean, median, 90th percentile and maximum of the errors, and mean and median of the least errors; zeros without a row.

    Order statistics come from a range sort of all rows, so no task holds the values of all queries.
    """
    e, o = F.col("position_error_m"), F.col("oracle_top_k_error_m")
    plain = results.agg(F.count("*").alias("queries"), stats.or_zero(F.avg(e)).alias("mean_error_m"), stats.or_zero(F.max(e)).alias("max_error_m"), stats.or_zero(F.avg(o)).alias("oracle_mean_error_m"))
    own = scans.order_statistics(results, [], "position_error_m", (0.5, 0.9)).select(stats.or_zero(scans.linear_of(0, 0.5)).alias("median_error_m"), stats.or_zero(scans.linear_of(1, 0.9)).alias("p90_error_m"))
    least = scans.order_statistics(results, [], "oracle_top_k_error_m", (0.5,)).select(stats.or_zero(scans.linear_of(0, 0.5)).alias("oracle_median_error_m"))
    both = plain.crossJoin(own).crossJoin(least)  # a row each
    return both.select("queries", "mean_error_m", "median_error_m", "p90_error_m", "max_error_m", "oracle_mean_error_m", "oracle_median_error_m")


def split_by_stride(df: DataFrame, stride: int, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Every ``stride``-th row as reference, the others as queries."""
    return df.where(F.col(seq) % stride == 0), df.where(F.col(seq) % stride != 0)


def position_by_path(rows: DataFrame, references: DataFrame, path: str = "reference_frame_path") -> DataFrame:
    """``ref_lat`` and ``ref_lon`` of the reference frame that ``path`` names, of several with one path the last; else null.

    ``references``: src_ord, seq, frame_path, ground_latitude, ground_longitude.
    """
    at = F.max_by(F.struct("ground_latitude", "ground_longitude"), F.struct("src_ord", "seq")).alias("at")
    known = references.where("frame_path is not null").groupBy(F.col("frame_path").alias(path)).agg(at)
    return rows.join(known, path, "left").withColumn("ref_lat", F.col("at.ground_latitude")).withColumn("ref_lon", F.col("at.ground_longitude")).drop("at")
