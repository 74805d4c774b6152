"""Scans: subtitle telemetry, CSV tables, tagged sets of them, tile metadata, image listings and descriptor tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.sequence import union_tagged

# The forms of the subtitle format.
FRAME = r"(FrameCnt|SrtCnt)\s*:?\s*(\d+),\s*DiffTime\s*:?\s*(\d+)ms"
# Hours take more than two digits from the hundredth on; their first digits are not to be left out.
TIME_RANGE = r"(\d{2,}:\d{2}:\d{2},\d{3})\s+-->\s+(\d{2,}:\d{2}:\d{2},\d{3})"
DATETIME = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+"


def srt_seconds(t: Column) -> Column:
    """``HH:MM:SS,mmm`` as seconds, with as many digits of hours as there are; null for anything else."""
    p = F.split(t, "[:,]")
    n = lambda k: F.get(p, F.lit(k)).try_cast("double")
    return n(0) * 3600 + n(1) * 60 + n(2) + n(3) / 1000


def found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def bracket_entries(body: Column) -> Column:
    """Array of (k, v) of all ``[k: v]`` and ``[k1: v1 k2: v2]`` groups, in order."""
    group = F.regexp_extract_all(body, F.lit(r"\[([^\]]+)\]"), F.lit(1))

    def pairs(g: Column) -> Column:
        tokens = F.filter(F.split(F.trim(g), r"\s+"), lambda x: x != "")
        two = (F.size(tokens) >= 4) & F.get(tokens, F.lit(0)).endswith(":") & F.get(tokens, F.lit(2)).endswith(":")
        at = lambda k: F.get(tokens, F.lit(k))
        entry = lambda k, v: F.struct(F.trim(k).alias("k"), F.trim(v).alias("v"))
        whole = entry(F.substring_index(g, ":", 1), F.substr(g, F.instr(g, ":") + 1))
        return F.when(two, F.array(entry(F.rtrim(F.regexp_replace(at(0), ":$", "")), at(1)), entry(F.regexp_replace(at(2), ":$", ""), at(3)))).when(F.instr(g, ":") > 0, F.array(whole)).otherwise(F.array().cast("array<struct<k:string,v:string>>"))

    return F.flatten(F.transform(group, pairs))


def bracket_metadata(entries: Column) -> Column:
    """Map of ``bracket_entries``, which stand in a column of their own; of equal keys the last one counts."""
    seen = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<struct<k:string,v:string>>").alias("kept"))

    def fold(s: Column, e: Column) -> Column:
        known = F.array_contains(s["keys"], e["k"])
        return F.struct(F.when(known, s["keys"]).otherwise(F.array_append(s["keys"], e["k"])).alias("keys"), F.when(known, s["kept"]).otherwise(F.array_append(s["kept"], e)).alias("kept"))

    return F.map_from_entries(F.reverse(F.aggregate(F.reverse(entries), seen, fold)["kept"]))


def last_of(entries: Column, key: str) -> Column:
    """The value of the last entry of ``key``, or null. ``entries`` is a column of its own, so nothing is parsed again."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def parse_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Telemetry rows of subtitle blocks. A block needs a number, a time range and one more line, or it is dropped."""
    lines = F.filter(F.transform(F.split(F.col(block), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    # behind a generator the lines are a column of their own, which the filter does not make anew
    b = blocks.withColumn("__l", F.explode(F.array(lines))).where((F.size("__l") >= 3) & F.get("__l", F.lit(0)).rlike(r"^\d+$") & F.get("__l", F.lit(1)).rlike(TIME_RANGE))
    b = b.withColumn("__body", F.concat_ws(" ", F.slice("__l", 3, F.size("__l")))).withColumn("__m", bracket_entries(F.col("__body")))
    head, times, body = F.get("__l", F.lit(0)), F.get("__l", F.lit(1)), F.col("__body")
    text = lambda k: last_of(F.col("__m"), k)
    # numeric-looking text is shown as the number that it is
    shown = lambda k: F.coalesce(text(k).try_cast("double").cast("string"), text(k)).alias(k)
    start, end = F.regexp_extract(times, TIME_RANGE, 1), F.regexp_extract(times, TIME_RANGE, 2)
    num = lambda k: text(k).try_cast("double").alias(k)
    drop = [c for c in b.columns if c in ("__l", "__body", "__m", block)]
    keep = [c for c in b.columns if c not in drop]
    return b.select(
        *keep, head.cast("long").alias("subtitle_index"), start.alias("start_time"), end.alias("end_time"), srt_seconds(start).alias("start_seconds"), srt_seconds(end).alias("end_seconds"),
        found(body, FRAME, 2).cast("long").alias("frame_count"), found(body, FRAME, 3).cast("long").alias("diff_time_ms"), found(body, DATETIME, 0).alias("timestamp"),
        num("iso"), shown("shutter"), num("fnum"), num("ev"), shown("color_md"), num("focal_len"), num("latitude"), num("longitude"), num("rel_alt"), num("abs_alt"), num("ct"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files as telemetry, with ``dataset_id`` from the file's stem; blocks end at blank lines."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("dataset_id"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return parse_blocks(t.select("dataset_id", F.posexplode(F.split("value", r"\r?\n\s*\r?\n")).alias("seq", "block")))


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV with header under a schema; empty cells are null, ``nan`` is NaN."""
    return spark.read.schema(ddl).option("header", True).option("nanValue", "nan").option("enforceSchema", False).csv(path)


def read_manifests(spark: SparkSession, parts: list[tuple[str, str]], ddl: str = schemas.MANIFEST) -> DataFrame:
    """NAME=PATH manifests, tagged and in order."""
    return union_tagged([(name, read_table(spark, path, ddl)) for name, path in parts])


def telemetry_aliases(df: DataFrame) -> DataFrame:
    """``timestamp`` or else ``gps_datetime``; ``start_seconds`` or else ``sample_time`` or 0."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.withColumn("timestamp", F.coalesce(blank("timestamp"), blank("gps_datetime"))).withColumn("start_seconds", F.coalesce("start_seconds", "sample_time", F.lit(0.0)))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TILE_META).option("multiLine", True).json(path)


def list_frames(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Image files in name order; the bytes are not read. ``frame_number``: all digits of the stem."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return f.withColumn("frame_number", frame_number(stem)).orderBy("path")


def frame_number(stem: Column) -> Column:
    return F.regexp_replace(stem, "[^0-9]", "").try_cast("long")


def frame_seconds(index: Column, fps: float, offset: float = 0.0) -> Column:
    return offset + (index - 1) / fps


#: Bytes of a matrix that one read takes.
NPY_CHUNK = 8 << 20


def npy_header(path: str) -> tuple[tuple[int, int], np.dtype, int]:
    """Shape, type and where the data begin, of a matrix in the ``.npy`` format by rows; only the head is read."""
    files, at = fs.FileSystem.from_uri(path)
    size = files.get_file_info(at).size
    with files.open_input_file(at) as f:
        head = io.BytesIO(f.read_at(min(size, 1 << 16), 0))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(head)
    if len(shape) != 2 or by_column or dtype.kind != "f":
        raise ValueError(f"{path} holds no matrix of floats by rows")
    if size < head.tell() + shape[0] * shape[1] * dtype.itemsize:
        raise ValueError(f"{path} is shorter than its {shape[0]} rows")
    return shape, dtype, head.tell()


def import_descriptors(spark: SparkSession, path: str, keys: DataFrame, ordinal: str) -> DataFrame:
    """``keys`` with ``v``, their rows of a ``.npy`` matrix by ``ordinal`` (from 0): an importer for legacy caches.

    The driver reads the head; ranges of bytes are read by the tasks, so the path must be one that they see. A matrix that
    does not have a row for each key, or a file that is short, is an error: descriptors are not to slip by a row.
    """
    (n, width), dtype, start = npy_header(path)
    if keys.count() != n or keys.where(F.col(ordinal).between(0, n - 1)).select(ordinal).distinct().count() != n:
        raise ValueError(f"{path} has {n} rows, which the keys' ordinals do not number")
    rows = max(1, NPY_CHUNK // max(1, width * dtype.itemsize))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(path)
        with files.open_input_file(at) as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    count = min(rows, n - first)
                    m = np.frombuffer(f.read_at(count * width * dtype.itemsize, start + first * width * dtype.itemsize), dtype).astype(np.float32)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * width, pa.int32()), pa.array(m))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count), pa.int64()), v], names=[ordinal, "v"])

    parts = max(1, -(-n // rows))
    ranges = spark.range(0, n, rows, numPartitions=min(parts, 10_000)).select("id")
    return keys.join(ranges.mapInArrow(run, f"{ordinal} long, v array<float>"), ordinal)
