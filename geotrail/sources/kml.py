"""Whole KML documents as tables of lines: styles, paths, points with descriptions and error lines.

A line of the document is a row with its place (section, item, part, seq), so a path of any length is rows, not a string,
and documents are sorted and written by executors. Every style that a row names is written, and no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written
from .sinks import escape, kml_coord, tenths, valid_coord, worst

PLACE = ("section", "item", "part", "seq")
LINE = "section int, item long, part int, seq long, line string"
#: Colours (alpha, blue, green, red) and widths of lines.
LINE_STYLES = {"drone-path": ("ffff7f00", 4), "truth-path": ("ff00aa00", 4), "estimate-path": ("ff0000ff", 4), "fix-path": ("ff00aa00", 3), "satellite-path": ("ffff5500", 3), "fallback-path": ("ff0055ff", 3), "error-line": ("44ffffff", 1)}
#: Colours and sizes of points.
POINT_STYLES = {"worst-point": ("ff00ffff", 0.9), "fix-point": ("ff00aa00", 0.6), "satellite-point": ("ffff5500", 0.6), "fallback-point": ("ff0055ff", 0.6), "truth-start": ("ff00aa00", 1.0), "estimate-start": ("ff0000ff", 1.0), "truth-dot": ("ff00aa00", 0.4), "estimate-dot": ("ff0000ff", 0.4)}
#: Statuses of the fused positions, in the order of their paths, with the kind that they are drawn as.
STATUSES = (("VPR_FIX", "fix"), ("SAT_FIX", "satellite"), ("VPR_FALLBACK", "fallback"), ("INTERP", "fallback"))
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>%s</name>'
FOOT = "</Document></kml>"


def _lines(df: DataFrame, section: int, item: Column, part: int, seq: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("long").alias("item"), F.lit(part).alias("part"), seq.cast("long").alias("seq"), line.alias("line"))


def path(points: DataFrame, section: int, item: int, name: str, style: str, lat: str, lon: str, order: Sequence[str]) -> DataFrame:
    """The rows of one path: a head, a row a valid position in ``order``, and a foot; none without a position."""
    fine = points.where(valid_coord(lat, lon))
    # the number of a range-sorted part and of the row in it order the rows, and no single task has them all
    dealt = fine.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    body = _lines(dealt.withColumn("__at", F.monotonically_increasing_id()), section, F.lit(item), 1, F.col("__at"), kml_coord(lat, lon))
    safe = name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    some = fine.agg(F.count("*").alias("n")).where("n > 0")
    head = _lines(some, section, F.lit(item), 0, F.lit(0), F.lit(f"<Placemark><name>{safe}</name><styleUrl>#{style}</styleUrl><LineString><tessellate>1</tessellate><altitudeMode>clampToGround</altitudeMode><coordinates>"))
    foot = _lines(some, section, F.lit(item), 2, F.lit(0), F.lit("</coordinates></LineString></Placemark>"))
    return head.unionByName(body).unionByName(foot)


def point(name: Column, style: Column, lat: str, lon: str, description: Sequence[Column]) -> Column:
    """A placemark with a description, a line of which is an element of ``description``; nulls in it are empty."""
    text = F.concat_ws("\n", *[F.coalesce(d, F.lit("")) for d in description])
    return F.concat(F.lit("<Placemark><name>"), escape(name), F.lit("</name><description>"), F.replace(escape(text), F.lit("\n"), F.lit("&#10;")), F.lit("</description><styleUrl>#"), style, F.lit("</styleUrl><Point><coordinates>"), kml_coord(lat, lon), F.lit("</coordinates></Point></Placemark>"))


def retrieval_document(frames: DataFrame, results: DataFrame, references: DataFrame, label: str, n_worst: int = 20) -> DataFrame:
    """Drone path, true and estimated paths of the video's centre, and the worst matches as points.

    ``frames``: frame_count, drone_latitude, drone_longitude, ground_latitude, ground_longitude; ``results``:
    query_frame_count, reference_dataset, reference_frame_count, position_error_m; ``references``: dataset_id,
    frame_count, ground_latitude, ground_longitude. A result whose frame or reference is unknown is not drawn.
    """
    known = references.select(F.col("dataset_id").alias("reference_dataset"), F.col("frame_count").alias("reference_frame_count"), F.col("ground_latitude").alias("est_lat"), F.col("ground_longitude").alias("est_lon"))
    at = frames.select(F.col("frame_count").alias("query_frame_count"), F.col("ground_latitude").alias("gt_lat"), F.col("ground_longitude").alias("gt_lon"))
    drawn = results.join(at, "query_frame_count").join(known, ["reference_dataset", "reference_frame_count"]).where(valid_coord("est_lat", "est_lon"))
    error = F.col("position_error_m")
    ranked = worst(drawn, "position_error_m", n_worst, "query_frame_count").withColumn("n", F.row_number().over(Window.orderBy(F.desc("position_error_m"), "query_frame_count")))  # n_worst rows
    name = F.concat(F.format_string("Worst error #%d: ", "n"), tenths(error), F.lit(" m"))
    at_text = lambda a, b: F.format_string("%.8f, %.8f", a, b)
    described = [
        F.concat(F.lit("Query frame: "), F.col("query_frame_count").cast("string")), F.concat(F.lit("Matched reference: "), F.col("reference_dataset"), F.lit(" frame "), F.col("reference_frame_count").cast("string")),
        F.format_string(f"{label.replace('%', '%%')} error: %.2f m", error), F.concat(F.lit("True centre: "), at_text("gt_lat", "gt_lon")), F.concat(F.lit("Estimated centre: "), at_text("est_lat", "est_lon"))]
    order = ["frame_count"]
    return (
        path(frames, 1, 0, "Captured drone path", "drone-path", "drone_latitude", "drone_longitude", order)
        .unionByName(path(frames, 1, 1, "True path of the video's centre", "truth-path", "ground_latitude", "ground_longitude", order))
        .unionByName(path(drawn, 1, 2, f"Estimated path of the video's centre ({label})", "estimate-path", "est_lat", "est_lon", ["query_frame_count"]))
        .unionByName(_lines(ranked, 2, F.col("n"), 1, F.col("n"), point(name, F.lit("worst-point"), "est_lat", "est_lon", described))))


def hybrid_document(fused: DataFrame, n_worst: int = 15) -> DataFrame:
    """True path, a path and coloured points for each status, and lines from truth to estimate of the worst errors.

    ``fused``: frame_count, time_s, final_status, gt_lat, gt_lon, final_lat, final_lon, final_error_m. Rows without a
    position stand on the true path alone.
    """
    fused = written(fused)  # read by each path
    out = path(fused, 1, 0, "Ground truth path", "truth-path", "gt_lat", "gt_lon", ["frame_count"])
    for k, (status, kind) in enumerate(STATUSES):
        out = out.unionByName(path(fused.where(F.col("final_status") == status), 1, k + 1, f"{status} path", f"{kind}-path", "final_lat", "final_lon", ["frame_count"]))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for s in STATUSES for v in s]), F.col("final_status")), F.lit("fallback"))
    fine = fused.where(valid_coord("final_lat", "final_lon"))
    name = F.concat(F.col("final_status"), F.format_string(" #%d (", "frame_count"), tenths(F.col("final_error_m")), F.lit(" m)"))
    at_text = lambda a, b: F.format_string("%.8f, %.8f", a, b)
    described = [
        F.format_string("Frame: %d  t=%.6fs", "frame_count", "time_s"), F.concat(F.lit("Status: "), F.col("final_status")), F.concat(F.lit("Error: "), tenths(F.col("final_error_m")), F.lit(" m")),
        F.concat(F.lit("GT: "), at_text("gt_lat", "gt_lon")), F.concat(F.lit("Est: "), at_text("final_lat", "final_lon"))]
    out = out.unionByName(_lines(fine, 2, F.col("frame_count"), 1, F.lit(0), point(name, F.concat(kind, F.lit("-point")), "final_lat", "final_lon", described)))
    ends = F.concat(F.lit("<Placemark><styleUrl>#error-line</styleUrl><LineString><tessellate>1</tessellate><coordinates>"), kml_coord("gt_lat", "gt_lon"), F.lit(" "), kml_coord("final_lat", "final_lon"), F.lit("</coordinates></LineString></Placemark>"))
    largest = worst(fine.where(valid_coord("gt_lat", "gt_lon")), "final_error_m", n_worst, "frame_count")
    return out.unionByName(_lines(largest, 3, F.col("frame_count"), 1, F.lit(0), ends))


def style_lines(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """A style a row, of each of ``names``; a name without a style is an error."""
    rows = []
    for k, n in enumerate(sorted(names)):
        if n in LINE_STYLES:
            colour, width = LINE_STYLES[n]
            inner = f"<LineStyle><color>{colour}</color><width>{width}</width></LineStyle>"
        else:
            colour, scale = POINT_STYLES[n]
            inner = f"<IconStyle><color>{colour}</color><scale>{scale}</scale><Icon><href>http://maps.google.com/mapfiles/kml/shapes/placemark_circle.png</href></Icon></IconStyle><LabelStyle><scale>0</scale></LabelStyle>"
        rows.append((0, k, 0, 0, f'<Style id="{n}">{inner}</Style>'))
    return spark.createDataFrame(rows, LINE)


def document(body: DataFrame, title: str) -> DataFrame:
    """``body`` with its head, the styles that it names, and its foot."""
    spark = body.sparkSession
    named = body.select(F.explode(F.regexp_extract_all("line", F.lit("<styleUrl>#([^<]*)</styleUrl>"), F.lit(1))).alias("s")).distinct()
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    frame = spark.createDataFrame([(-1, 0, 0, 0, HEAD % safe), (9, 0, 0, 0, FOOT)], LINE)
    return frame.unionByName(style_lines(spark, [r["s"] for r in named.collect()])).unionByName(body)  # as many names as styles exist


def write_document(body: DataFrame, folder: str, title: str) -> None:
    """The document as one text file in ``folder``: sorted by all tasks, written by one of them row by row."""
    document(body, title).orderBy(*PLACE).select("line").coalesce(1).write.mode("overwrite").text(folder)
