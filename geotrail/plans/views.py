"""Domain tables derived from the shared ``events`` and ``embeddings`` by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import located, top_references


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return from_events(e)


def from_events(e: DataFrame) -> DataFrame:
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    w = Window.partitionBy("user_id")
    e = e.withColumn("seq", F.row_number().over(w.orderBy("us", "event_id")).cast("long")).withColumn("start_seconds", (F.col("us") - F.min("us").over(w)) / 1e6)
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("dataset_id"), "seq", F.col("event_id").alias("frame_count"), "start_seconds",
        F.when(bad, 0.0).otherwise(32.10 + F.col("seq") * 2e-5 + F.col("event_id") % 7 * 1e-6).alias("latitude"),
        F.when(bad, 0.0).otherwise(35.20 + F.col("seq") * 3e-5 + F.col("event_id") % 11 * 1e-6).alias("longitude"),
        F.when(F.col("k") % 10 != 0, F.col("value") / 4).alias("rel_alt"), F.when(F.col("k") % 3 == 0, F.col("k") * 7.0 - 180).alias("drone_yaw"),
        F.lit(None).cast("double").alias("gimbal_yaw"), F.when(F.col("k") % 5 == 0, -60.0 + F.col("k") % 10).alias("gimbal_pitch"), (F.col("event_type") == "view").alias("is_frame"), "k", "event_type")


def srt_hours(i: Column) -> Column:
    """The hours of ``i`` seconds: two digits, or as many as they need (``lpad`` alone would cut the third)."""
    hours = F.floor(i / 3600).cast("string")
    return F.lpad(hours, F.greatest(F.lit(2), F.length(hours)), "0")


def subtitle_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitle text made of integers only, with a start time that doesn't parse for ``error`` rows."""
    e = events(spark, sf)
    i, k = F.col("event_id"), F.col("k")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    s = lambda c: c.cast("string")
    ms = pad(i % 1000, 3)
    clock = F.concat(srt_hours(i), F.lit(":"), pad(F.floor(i / 60) % 60, 2), F.lit(":"), pad(i % 60, 2), F.when(F.col("event_type") == "error", ".").otherwise(","), ms)
    block = F.concat(
        s(i + 1), F.lit("\n"), clock, F.lit(" --> 00:00:00,000\nFrameCnt: "), s(i), F.lit(", DiffTime: 33ms\n2024-01-01 00:00:00."), ms, F.lit("\n[iso: "), s(k), F.lit("] [shutter: 1/"), s(k + 50),
        F.lit(".0] [latitude: 32."), pad(104000 + i % 1000, 6), F.lit("] [longitude: 35."), pad(207000 + i % 997, 6), F.lit("] [rel_alt: "), s(k), F.lit(".5 abs_alt: "), s(k + 600), F.lit(".5]"))
    return e.select("event_id", block.alias("block"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with descriptors: the stated query set, and all other frames as references."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    role = F.when(F.col("vec_id") % 5 == 1, "query").otherwise("reference")
    return e.select(
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("dataset_id"), F.col("vec_id").alias("frame_count"), F.col("vec_id").cast("double").alias("start_seconds"), role.alias("role"),
        (32.10 + F.get("embedding", F.lit(0)).cast("double") * 0.01).alias("ground_latitude"), (35.20 + F.get("embedding", F.lit(1)).cast("double") * 0.01).alias("ground_longitude"), F.col("embedding").alias("v"))


#: Origin of the local frame of all retrieval views.
LAT0, LON0 = 32.10, 35.20


def top_candidates(spark: SparkSession, sf: str, k: int = 6, max_gap_s: float | None = None, refs: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    f = frames(spark, sf)
    side = lambda d, key: d.select(F.col("frame_count").alias(key), "v", F.col("start_seconds").alias("t"))
    q = side(f.where("role = 'query'") if queries is None else queries, "q")
    r = side(f.where("role = 'reference'") if refs is None else refs, "r").withColumn("ord", F.col("r"))
    return located(top_references(q, r, k, max_gap_s), f.drop("v"), LAT0, LON0)


def candidates(spark: SparkSession, sf: str, k: int = 6) -> DataFrame:
    """The ``k`` best candidates of each frame, ranked, with match counts made from the frame numbers."""
    q, r = F.col("q"), F.col("r")
    t = top_candidates(spark, sf, k).withColumn("lg_match_count", (q * 31 + r * 17) % 900)
    t = t.withColumn("lg_inlier_count", F.floor(F.col("lg_match_count") * ((q * 7 + r * 13) % 101) / 100).cast("long"))
    return t.withColumn("lg_inlier_ratio", F.col("lg_inlier_count") / F.greatest("lg_match_count", F.lit(1))).withColumnRenamed("q_dataset", "dataset_id")


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf)
    source = F.when(F.col("event_type").isin("click", "view"), "SAT").when(F.col("event_type") == "purchase", "VPR_FALLBACK").otherwise("NO_FIX")
    i, s = F.col("frame_count"), F.col("seq")
    t = t.withColumn("source", source).withColumn("gt_lat", 32.10 + s * 2e-5).withColumn("gt_lon", 35.20 + s * 3e-5)
    has = F.col("source") != "NO_FIX"
    return t.withColumn("raw_lat", F.when(has, F.col("gt_lat") + (i * 37 % 101 - 50) * 1e-6)).withColumn("raw_lon", F.when(has, F.col("gt_lon") + (i * 53 % 101 - 50) * 1e-6)).select("dataset_id", "seq", "frame_count", "start_seconds", "source", "raw_lat", "raw_lon", "gt_lat", "gt_lon", "k", "rel_alt")
