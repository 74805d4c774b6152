"""Gap filling, smoothing and interpolation of paths, and the sweeps that choose a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.scratch import written
from . import scans
from .sequence import FLIGHT, along, from_here, so_far


def weighted(x: str, offsets: dict[int, float]) -> Column:
    """Weighted mean of the neighbours at ``offsets`` (negative: earlier), over those that there are."""
    total = norm = F.lit(0.0)
    for k, g in offsets.items():
        v = F.lag(x, -k).over(along()) if k < 0 else F.lead(x, k).over(along()) if k else F.col(x)
        total = total + F.coalesce(v * g, F.lit(0.0))
        norm = norm + F.when(v.isNotNull(), g).otherwise(0.0)
    return F.when(F.col(x).isNotNull(), total / norm)


def symmetric(x: str, half: int) -> Column:
    return F.col(x) if half == 0 else weighted(x, {k: geo.gauss(k, 0.6 * half) for k in range(-half, half + 1)})


def causal(x: str, half: int) -> Column:
    return F.col(x) if half == 0 else weighted(x, {-k: geo.gauss(k, 0.6 * half) for k in range(2 * half + 1)})


def fill_batch(x: str) -> Column:
    """Last fix so far; before the first one the first one, 0 if there is none."""
    return F.coalesce(F.last(x, ignorenulls=True).over(so_far()), F.first(x, ignorenulls=True).over(from_here()), F.lit(0.0))


def fill_causal(x: str) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def live_path(fixes: DataFrame, half: int = 4) -> DataFrame:
    """Causal fill, then causal smoothing over filled rows only; rows before the first fix stay null."""
    f = fixes.withColumn("filled_lat", fill_causal("raw_lat")).withColumn("filled_lon", fill_causal("raw_lon"))
    return f.withColumn("smoothed_lat", causal("filled_lat", half)).withColumn("smoothed_lon", causal("filled_lon", half))


def index_stats(rows: DataFrame, groups: list[str], x: str) -> DataFrame:
    """Count, mean, the values at ``int(0.5 n)`` and ``int(0.9 n)``, and maximum of ``x`` in each group, at four places.

    The values are read twice and so are to be a table; order statistics come from a range sort over all groups.
    """
    v = F.col(x)
    plain = rows.groupBy(*groups).agg(F.count(v).alias("count"), F.round(F.avg(v), 4).alias("mean_m"), F.round(F.max(v), 4).alias("max_m"))
    at = scans.order_statistics(rows, groups, x, (0.5, 0.9)).select(*[F.col(g).alias(f"__k_{g}") for g in groups], F.round("at_0", 4).alias("median_m"), F.round("at_1", 4).alias("p90_m"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__k_{g}"))
    return plain.join(at, same).select(*groups, "count", "mean_m", "median_m", "p90_m", "max_m")


def window_sweep(path: DataFrame, smooth, lat: str, lon: str, most: int = 6) -> DataFrame:
    """Error statistics of every half window per flight, over rows with ground truth."""
    p = path
    for h in range(most + 1):
        p = p.withColumn(f"__a{h}", smooth(lat, h)).withColumn(f"__b{h}", smooth(lon, h))
    p = p.where("gt_lat is not null and gt_lon is not null")
    each = F.array(*[F.struct(F.lit(h).alias("half_window"), geo.haversine(f"__a{h}", f"__b{h}", "gt_lat", "gt_lon").alias("error_m")) for h in range(most + 1)])
    p = p.select(FLIGHT, F.explode(each).alias("e")).select(FLIGHT, "e.*").where("error_m is not null")
    return index_stats(written(p), [FLIGHT, "half_window"], "error_m")


def best_window(sweep: DataFrame) -> DataFrame:
    """Least rounded mean, the smallest window of equals."""
    return sweep.groupBy(FLIGHT).agg(F.min_by(F.struct("half_window", "mean_m", "median_m", "p90_m", "max_m"), F.struct("mean_m", "half_window")).alias("b")).select(FLIGHT, "b.*")


def interpolate(path: DataFrame, lat: str = "raw_lat", lon: str = "raw_lon", at: str = "frame_count") -> DataFrame:
    """Linear in ``at`` between fixes (rows with a position), held at both ends; null without any fix."""
    w_back, w_on = so_far(at), from_here(at)
    mark = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    p = path.withColumn("__fix", mark).withColumn("__a", F.last("__fix", ignorenulls=True).over(w_back)).withColumn("__b", F.first("__fix", ignorenulls=True).over(w_on))
    t = (F.col(at) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    pick = lambda c: F.when(F.col("__fix").isNotNull(), F.col(f"__fix.{c}")).when(F.col("__a").isNull(), F.col(f"__b.{c}")).when(F.col("__b").isNull(), F.col(f"__a.{c}")).otherwise(geo.lerp(F.col(f"__a.{c}"), F.col(f"__b.{c}"), t))
    method = F.when(F.col("__fix").isNotNull(), "FIX").otherwise("INTERPOLATED")
    return p.withColumn("method", method).withColumn("est_latitude", pick("lat")).withColumn("est_longitude", pick("lon")).drop("__fix", "__a", "__b")
