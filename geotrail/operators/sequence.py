"""Orders, headings, fills and nearest-time alignment along flights. A flight is one partition of every window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo

FLIGHT = "dataset_id"
ORDER = ("start_seconds", "frame_count")


def along(*order: str) -> WindowSpec:
    return Window.partitionBy(FLIGHT).orderBy(*(order or ORDER))


def so_far(*order: str) -> WindowSpec:
    return along(*order).rowsBetween(Window.unboundedPreceding, 0)


def from_here(*order: str) -> WindowSpec:
    return along(*order).rowsBetween(0, Window.unboundedFollowing)


def with_sequence(df: DataFrame, name: str = "seq") -> DataFrame:
    """Dense numbers from 0 in flight order."""
    return df.withColumn(name, F.row_number().over(along()).cast("long") - 1)


def forward_fill(x: str) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def fill_both(x: str) -> Column:
    """The last value so far, or else the next one."""
    return F.coalesce(forward_fill(x), F.first(x, ignorenulls=True).over(from_here()))


def valid_gps(df: DataFrame) -> DataFrame:
    """Rows with both coordinates, neither of them zero."""
    return df.where((F.abs("latitude") > 1e-9) & (F.abs("longitude") > 1e-9))


def with_origin(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """First position of the flight as ``lat0`` and ``lon0``."""
    w = so_far()
    return df.withColumn("lat0", F.first(lat).over(w)).withColumn("lon0", F.first(lon).over(w))


def with_local_xy(df: DataFrame) -> DataFrame:
    x, y = geo.local_xy("latitude", "longitude", "lat0", "lon0")
    return with_origin(df).withColumn("x_m", x).withColumn("y_m", y)


def _bearing(back: int, ahead: int, least_m: float) -> Column:
    w = along().rowsBetween(-back, ahead)
    dx, dy = F.last("x_m").over(w) - F.first("x_m").over(w), F.last("y_m").over(w) - F.first("y_m").over(w)
    return F.when(geo.length(dx, dy) >= least_m, geo.heading(dx, dy))


def with_headings(df: DataFrame, window: int = 30, least_m: float = 2.0) -> DataFrame:
    """``causal_heading`` from past positions only, filled forward; ``centred_heading`` for evaluation, filled both ways."""
    df = df.withColumn("__a", _bearing(window, 0, least_m)).withColumn("__b", _bearing(window, window, least_m))
    return df.withColumn("causal_heading", forward_fill("__a")).withColumn("centred_heading", fill_both("__b")).drop("__a", "__b")


def dedupe_keep_last(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """Of the rows of a key the last one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered_unique(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """Of the rows of a key the first one."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_tagged(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """UNION ALL with the name of each source and its place, so that the order stays known."""
    tagged = [d.withColumn(FLIGHT, F.lit(name)).withColumn("src_ord", F.lit(k)) for k, (name, d) in enumerate(parts)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return out


def nearest_in_time(frames: DataFrame, points: DataFrame, payload: list[str], inside: bool = True) -> DataFrame:
    """Each frame (dataset_id, frame_count, start_seconds) with the nearest point of its flight.

    Ties go to the point that comes first (``seq``); ``inside`` drops frames outside the points' time range. Two
    ordered passes over the union of both sides find the neighbours, so no pair is formed.
    """
    body = F.struct(F.col("start_seconds").alias("t"), "seq", *payload)
    p = points.select(FLIGHT, F.col("start_seconds").alias("t"), F.lit(1).alias("is_point"), "seq", F.lit(None).cast("long").alias("frame_count"), body.alias("p"))
    f = frames.select(FLIGHT, F.col("start_seconds").alias("t"), F.lit(0).alias("is_point"), F.lit(None).cast("long").alias("seq"), "frame_count", F.lit(None).cast(p.schema["p"].dataType).alias("p"))
    w = Window.partitionBy(FLIGHT)
    # of points at one time the first one stands next to a frame on either side
    before = w.orderBy("t", F.desc("is_point"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    after = w.orderBy("t", "is_point", "seq").rowsBetween(0, Window.unboundedFollowing)
    both = p.unionByName(f).withColumn("a", F.last("p", ignorenulls=True).over(before)).withColumn("b", F.first("p", ignorenulls=True).over(after)).where("is_point = 0")
    if inside:
        both = both.where("a is not null and b is not null")
    da, db = F.col("t") - F.col("a.t"), F.col("b.t") - F.col("t")
    pick = F.when(F.col("b").isNull() | (da < db) | ((da == db) & (F.col("a.seq") <= F.col("b.seq"))), F.col("a")).otherwise(F.col("b"))
    pick = F.when(F.col("a").isNull(), F.col("b")).otherwise(pick)
    return both.withColumn("hit", pick).select(FLIGHT, "frame_count", F.col("t").alias("start_seconds"), F.col("hit.t").alias("point_seconds"), *[F.col(f"hit.{c}").alias(c) for c in payload])


def since_last(flag: Column, t: str = "start_seconds") -> Column:
    """Seconds since the previous flagged row, on flagged rows; null on the first."""
    w = along().rowsBetween(Window.unboundedPreceding, -1)
    return F.when(flag, F.col(t) - F.last(F.when(flag, F.col(t)), ignorenulls=True).over(w))


def path_length(df: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
    dx, dy = F.col(x) - F.lag(x).over(along()), F.col(y) - F.lag(y).over(along())
    return df.withColumn("__d", geo.length(dx, dy)).groupBy(FLIGHT).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("path_m"))


def early_rows(df: DataFrame, first: int = 30, every: int = 5, order: tuple[str, ...] = ("start_seconds", "frame_count")) -> DataFrame:
    """Of the ``first`` rows of each flight every ``every``-th one, with its place ``idx`` from 0."""
    idx = F.row_number().over(Window.partitionBy(FLIGHT).orderBy(*order)) - 1
    return df.withColumn("idx", idx).where((F.col("idx") < first) & (F.col("idx") % every == 0))


def query_times(results: DataFrame, times: DataFrame, place: str = "seq") -> DataFrame:
    """``time_s`` of each row: of its flight and ``frame_count`` in ``times`` (of several the last), else its own place.

    Flights number their frames alike, so the flight is part of the key wherever both tables name it.
    """
    keys = [c for c in (FLIGHT, "frame_count") if c in results.columns and c in times.columns]
    known = dedupe_keep_last(times, *keys).select(*keys, F.col("start_seconds").alias("__t"))
    return results.join(known, keys, "left").withColumn("time_s", F.coalesce("__t", F.col(place).cast("double"))).drop("__t")
