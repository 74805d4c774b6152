"""Sinks: CSV, JSON summaries, KML and SVG. Rows are rendered by expressions; only small reports reach the driver."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[str], single_file: bool = True) -> None:
    out = df.orderBy(*order)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    """The one row of a summary as JSON."""
    text = df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).first()[0]
    Path(path).write_text(text + "\n", encoding="utf-8")


def escape(x: Column) -> Column:
    """XML text, in the order & < > " '."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def valid_coord(lat: str, lon: str) -> Column:
    """Present, a number, not NaN and not zero."""
    fine = lambda c: F.coalesce(F.col(c).try_cast("double").isNotNull() & ~F.isnan(F.col(c).try_cast("double")) & (F.col(c).try_cast("double") != 0), F.lit(False))
    return fine(lat) & fine(lon)


def kml_coord(lat: str, lon: str, alt: Column | None = None) -> Column:
    return F.format_string("%.8f,%.8f,%.2f", F.col(lon), F.col(lat), F.lit(0.0) if alt is None else alt)


def line_string(df: DataFrame, group: str, lat: str, lon: str, order: str) -> DataFrame:
    """Space-joined coordinates of each group in order. For paths of the size of a flight."""
    pts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), kml_coord(lat, lon).alias("c"))))
    return df.where(valid_coord(lat, lon)).groupBy(group).agg(F.array_join(F.transform(pts, lambda p: p["c"]), " ").alias("coordinates"))


def placemarks(lines: DataFrame, name: str, colour: str = "ff0000ff", width: int = 3) -> DataFrame:
    body = F.concat(F.lit("<Placemark><name>"), escape(F.col(name)), F.lit(f"</name><Style><LineStyle><color>{colour}</color><width>{width}</width></LineStyle></Style><LineString><coordinates>"), F.col("coordinates"), F.lit("</coordinates></LineString></Placemark>"))
    return lines.select(name, body.alias("xml"))


def point_placemarks(points: DataFrame, name: str, lat: str, lon: str, style: str) -> DataFrame:
    """``xml`` beside each row with a position: a named point of a style."""
    text = F.concat(F.lit("<Placemark><name>"), escape(F.col(name)), F.lit("</name><styleUrl>#"), F.col(style), F.lit("</styleUrl><Point><coordinates>"), kml_coord(lat, lon), F.lit("</coordinates></Point></Placemark>"))
    return points.where(valid_coord(lat, lon)).withColumn("xml", text)


def error_placemarks(df: DataFrame, name: str, order: str, error: str = "error_m", n: int = 20) -> DataFrame:
    """A line from the true to the estimated position of each of the ``n`` largest errors."""
    ends = F.concat_ws(" ", kml_coord("gt_lat", "gt_lon"), kml_coord("est_lat", "est_lon"))
    fine = df.where(valid_coord("gt_lat", "gt_lon") & valid_coord("est_lat", "est_lon"))
    return placemarks(worst(fine, error, n, order).withColumn("coordinates", ends), name, "ff00ffff", 2)


def live_points(results: DataFrame, order: tuple[str, ...] = ("start_seconds", "frame_count"), first: int = 30, every: int = 5) -> DataFrame:
    """(dataset_id, idx, label, style, lat, lon): where both paths of a flight start, and their dots of the first rows.

    ``results``: gt_lat, gt_lon, est_lat, est_lon. The estimate starts at its first fix, whose row the label names.
    """
    w = Window.partitionBy("dataset_id")
    known = F.col("est_lat").isNotNull() & F.col("est_lon").isNotNull()
    r = results.withColumn("idx", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("start", F.min(F.when(known, F.col("idx"))).over(w))
    r = r.where((F.col("idx") < first) | (F.col("idx") == F.col("start")))
    dot = (F.col("idx") < first) & (F.col("idx") % every == 0)

    def mark(when, label, style: str, side: str):
        return F.when(when, F.struct(label.alias("label"), F.lit(style).alias("style"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon")))

    begun = F.when(F.col("idx") > 0, F.format_string("estimate begins at row %d", "idx")).otherwise("estimate begins")
    marks = F.array(
        mark(F.col("idx") == 0, F.lit("truth begins"), "truth-start", "gt"), mark(F.col("idx") == F.col("start"), begun, "estimate-start", "est"),
        mark(dot, F.format_string("truth +%d s", "idx"), "truth-dot", "gt"), mark(dot & known, F.format_string("estimate +%d s", "idx"), "estimate-dot", "est"))
    return r.select("dataset_id", "idx", F.explode(F.array_compact(marks)).alias("m")).select("dataset_id", "idx", "m.*")


def tenths(x: Column) -> Column:
    """A number of zero or more with one decimal, the nearer one of what the double holds exactly (of a tie the even one).

    The formatter of the JVM rounds the shortest decimals of a double instead, so 4.35, which is a little less, would
    become 4.4. Ten times the number is a sum of two doubles, eight and two times it; what that sum leaves out decides.
    """
    ten = x * 8 + x * 2
    lost = x * 2 - (ten - x * 8)
    whole = F.floor(ten)
    rest = ten - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    return F.format_string("%.1f", (whole + F.when(up, 1).otherwise(0)) / 10.0)


def worst(df: DataFrame, error: str, n: int, order: str) -> DataFrame:
    """The ``n`` largest errors, the earlier row of equals."""
    return df.orderBy(F.desc(error), order).limit(n)


def write_kml(marks: DataFrame, path: str, title: str) -> None:
    """Placemark rows as one local document, with the styles that they name, a row after the other.

    For a report of the size of the paths shown; :mod:`.kml` writes documents of any size from the executors.
    """
    from .kml import FOOT, HEAD, style_lines

    named = marks.select(F.explode(F.regexp_extract_all("xml", F.lit("<styleUrl>#([^<]*)</styleUrl>"), F.lit(1))).alias("s")).distinct().collect()  # as many as styles exist
    with open(path, "w", encoding="utf-8") as f:
        f.write(HEAD % html.escape(title) + "\n")
        for r in style_lines(marks.sparkSession, [r["s"] for r in named]).orderBy("item").select("line").collect():
            f.write(r["line"] + "\n")
        for r in marks.select("xml").toLocalIterator():
            f.write(r["xml"] + "\n")
        f.write(FOOT + "\n")


def svg_fit(points: DataFrame, x: str, y: str, width: float = 1000.0, height: float = 700.0, margin: float = 40.0) -> DataFrame:
    """Points scaled alike in both axes to fit a box, north up."""
    w = Window.partitionBy("dataset_id")
    x0, x1, y0, y1 = F.min(x).over(w), F.max(x).over(w), F.min(y).over(w), F.max(y).over(w)
    scale = F.least((width - 2 * margin) / F.greatest(x1 - x0, F.lit(1.0)), (height - 2 * margin) / F.greatest(y1 - y0, F.lit(1.0)))
    return points.withColumn("scale", scale).withColumn("svg_x", margin + (F.col(x) - x0) * F.col("scale")).withColumn("svg_y", height - margin - (F.col(y) - y0) * F.col("scale"))


def error_opacity(error: str) -> Column:
    return F.least(F.lit(0.6), 0.1 + F.col(error) / 60.0)


def error_lines(points: DataFrame) -> DataFrame:
    """``xml`` beside each row: a line from (svg_x, svg_y) to (est_x, est_y), the more opaque the larger ``error_m`` is."""
    shape = F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f" stroke="red" stroke-opacity="%.2f"/>', "svg_x", "svg_y", "est_x", "est_y", error_opacity("error_m"))
    return points.where("est_x is not null and est_y is not null and error_m is not null").withColumn("xml", shape)


def write_svg(points: DataFrame, path: str, order: str, width: float = 1000.0, height: float = 700.0, errors: DataFrame | None = None) -> None:
    """A polyline per flight over :func:`svg_fit` points, lines of :func:`error_lines`, and a 50 m bar, a row after the other."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">\n')
        scale, flight = None, None
        for r in points.orderBy("dataset_id", order).select("dataset_id", "scale", F.format_string("%.1f,%.1f", "svg_x", "svg_y").alias("p")).toLocalIterator():
            if scale is None or r["dataset_id"] != flight:
                f.write(('"/>\n' if scale is not None else "") + '<polyline fill="none" stroke="black" points="')
                scale, flight = (r["scale"] if scale is None else scale), r["dataset_id"]
            f.write(r["p"] + " ")
        if scale is not None:
            f.write('"/>\n')
        for r in errors.select("xml").toLocalIterator() if errors is not None else ():
            f.write(r["xml"] + "\n")
        if scale is not None:
            f.write(f'<line x1="40" y1="{height - 15}" x2="{40 + 50 * scale:.1f}" y2="{height - 15}" stroke="black"/>\n')
        f.write("</svg>\n")
