"""Fusion of position sources by status, decision lists, and summaries by status and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Live
from ..functions import geo
from . import scans


def fuse(manifest: DataFrame, decisions: DataFrame, vpr: DataFrame, satellite: DataFrame, keys: list[str]) -> DataFrame:
    """Four-way left join on the frame: a gated fix, else a satellite fix, else the retrieval position.

    ``vpr`` (vpr_lat, vpr_lon), ``decisions`` (decision), ``satellite`` (sat_status, sat_lat, sat_lon). Without a
    retrieval row the position stays null rather than becoming the ground truth.
    """
    m = manifest.join(decisions, keys, "left").join(vpr, keys, "left").join(satellite, keys, "left")
    ok = F.coalesce(F.col("sat_status") == "ok", F.lit(False))
    status = F.when(F.col("decision") == "FIX", "VPR_FIX").when(ok, "SAT_FIX").otherwise("VPR_FALLBACK")
    m = m.withColumn("final_status", status)
    sat = F.col("final_status") == "SAT_FIX"
    lat, lon = F.when(sat, F.col("sat_lat")).otherwise(F.col("vpr_lat")), F.when(sat, F.col("sat_lon")).otherwise(F.col("vpr_lon"))
    return m.withColumn("final_error_m", F.round(geo.haversine("gt_lat", "gt_lon", lat, lon), 2)).withColumn("final_lat", F.round(lat, 7)).withColumn("final_lon", F.round(lon, 7))


def _plain_stats(x: str) -> list[Column]:
    v = F.col(x)
    pct = lambda t: F.round(100.0 * F.count_if(v <= t) / F.count(v), 1).alias(f"pct_{t}m")
    return [F.count("*").alias("count"), F.round(F.avg(v), 2).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), *[pct(t) for t in (5, 10, 15, 20)]]


def by_status_and_overall(df: DataFrame, status: str, error: str) -> DataFrame:
    """GROUPING SETS ((status), ()) over errors that are rounded already; the overall row is ``ALL``.

    Medians are order statistics of a range sort over all rows, as one status, and all of them, may be most of the table.
    """
    plain = df.rollup(status).agg(F.grouping(status).alias("__g"), *_plain_stats(error))
    median = F.round(scans.linear_of(0, 0.5), 2).alias("median")
    own = scans.order_statistics(df, [status], error, (0.5,)).select(F.col(status).alias("__s"), F.lit(0).alias("__h"), median)
    every = scans.order_statistics(df, [], error, (0.5,)).select(F.lit(None).cast("string").alias("__s"), F.lit(1).alias("__h"), median)
    out = plain.join(own.unionByName(every), (F.col("__g") == F.col("__h")) & F.col(status).eqNullSafe(F.col("__s")), "left")
    out = out.withColumn(status, F.when(F.col("__g") == 1, "ALL").otherwise(F.col(status)))
    return out.select(status, "count", "median", "mean", "min", "max", "pct_5m", "pct_10m", "pct_15m", "pct_20m")


def satellite_status(cfg: Live = Live()) -> Column:
    """First reason against a satellite fix, in the order of the live loop."""
    high = F.coalesce(F.col("rel_alt") >= cfg.min_altitude_m, F.lit(False))
    return (
        F.when(~F.col("have_fix"), "no_position_yet").when(~high, "low_alt").when(F.col("heading_deg").isNull(), "no_heading_yet").when(~F.col("has_image"), "no_image")
        .when(F.col("matches") < cfg.min_matches, "few_matches").when(F.col("inliers") < cfg.min_inliers, "ransac_fail").otherwise("ok"))


def evaluation_status(cfg: Live = Live()) -> Column:
    """The same for the evaluation, which asks for the heading first and knows match errors."""
    high = F.coalesce(F.col("rel_alt") >= cfg.min_altitude_m, F.lit(False))
    return (
        F.when(F.col("heading_deg").isNull(), "no_heading_yet").when(~high, "low_alt").when(~F.col("has_image"), "no_image").when(F.col("matches").isNull(), "match_error")
        .when(F.col("matches") < cfg.min_matches, "few_matches").when(F.col("inliers") < cfg.min_inliers, "ransac_fail").otherwise("ok"))


def best_by_inliers(candidates: DataFrame, key: str) -> DataFrame:
    """Most inliers, the most similar of equals."""
    return candidates.groupBy(key).agg(F.max_by(F.struct("r", "lg_inlier_count", "lg_inlier_ratio"), F.struct("lg_inlier_count", -F.col("rank"))).alias("b")).select(key, "b.*")


def cascade(frames: DataFrame, fallback, key: str, cfg: Live = Live()) -> DataFrame:
    """SAT where the status is ok; only the other frames go to ``fallback`` (frames -> key, lg_inlier_count, lg_inlier_ratio)."""
    sat = frames.where("sat_status = 'ok'").select(key, "sat_status", F.lit("SAT").alias("source"))
    rest = frames.where("sat_status <> 'ok'")
    good = (F.col("lg_inlier_count") >= cfg.vpr_inliers) & (F.col("lg_inlier_ratio") >= cfg.vpr_ratio)
    found = rest.join(fallback(rest), key, "left").select(key, "sat_status", F.when(good, "VPR_FALLBACK").otherwise("NO_FIX").alias("source"))
    return sat.unionByName(found)


def threshold_hits(df: DataFrame, error: str, thresholds: tuple = (5, 10, 15, 20, 30)) -> DataFrame:
    """Frames with an error within each threshold, as a share of all frames, with or without an error."""
    counts = df.agg(F.count("*").alias("frames"), *[F.count_if(F.col(error) <= t).alias(f"t{t}") for t in thresholds])
    each = F.array(*[F.struct(F.lit(t).alias("threshold_m"), F.col(f"t{t}").alias("hits")) for t in thresholds])
    return counts.select("frames", F.explode(each).alias("h")).select("h.threshold_m", "h.hits", F.round(100.0 * F.col("h.hits") / F.greatest("frames", F.lit(1)), 1).alias("percent"))


def timing_summary(df: DataFrame, seconds: str, triggered: str) -> DataFrame:
    """Means, the median (by a range sort over all rows) and the maximum of seconds a frame, and frames a second."""
    s = F.col(seconds)
    plain = df.agg(
        F.avg(s).alias("mean_s"), F.max(s).alias("max_s"), F.avg(F.when(~F.col(triggered), s)).alias("satellite_only_mean_s"),
        F.avg(F.when(F.col(triggered), s)).alias("fallback_mean_s"), (1.0 / F.avg(s)).alias("fps"))
    median = scans.order_statistics(df, [], seconds, (0.5,)).select(scans.linear_of(0, 0.5).alias("median_s"))
    return plain.crossJoin(median).select("mean_s", "median_s", "max_s", "satellite_only_mean_s", "fallback_mean_s", "fps")  # a row each
