"""Mixing sources to target weights as a time-varying curriculum, with DataFrame and SQL functions alone.

A source's rate over training time t in [0, 1] is ``target * (1 + tilt * (2 t - 1))``, a linear schedule whose integral
is the source's target. Documents of a source stand in a keyed order, repeated as often as the target needs; the word
that a document starts at, as a share of the target, is inverted through the integral to its training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights and tilts of the sources by code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
TILTS = (0.5, 0.0, -0.5)
#: Leading hexadecimal digits of the order key that part a source into buckets for its running sums.
BUCKET_DIGITS = 3


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def source_targets(sources: DataFrame, share: float, cap: int, weights: tuple, tilts: tuple) -> DataFrame:
    """(source, source_size) -> with ``target`` and ``tilt``: shares of ``share`` times all sizes by weight, none above
    ``cap`` times its source's size, the excess going to the others by weight.

    Sources in the order of cap over weight fill up one after the other; the level at which the first one doesn't fill
    is everyone's. One row per source: the only table that a single task sorts.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", pick(weights, F.col("rank"))).withColumn("tilt", pick(tilts, F.col("rank")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max(F.expr("CASE WHEN ratio > level THEN level END")).over(every))
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")), F.col("most").cast("double"))
    return ranked.select("source", "source_size", "tilt", target.alias("target"))


def position(share_done: Column, tilt: Column) -> Column:
    """The time at which the integral of the schedule reaches ``share_done``."""
    root = (tilt - 1 + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share_done)) / (2 * tilt)
    return F.round(F.when(tilt == 0, share_done).otherwise(root), 6)


def training_mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple = WEIGHTS, tilts: tuple = TILTS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and ``position_1`` to ``position_<cap>``.

    ``taken`` are the words that the mix takes, repeats counted: every pass over a source takes whole documents in the
    order of a digest of the id until its target is met, the last one in part. A position is null for a pass that takes
    none of the document. Null and empty texts have size 0; a source of size 0 has target 0; null is a source. Rows of
    equal id follow each other by size, equal rows are interchangeable, so reruns agree. Running sums go over buckets of
    the order key, pre-aggregated, so a source with most rows is spread like any other.
    """
    return _mix(docs.withColumn("__row", F.lit(0)), share, cap, weights, tilts, doc_id, text, source).drop("__row")


def _mix(docs: DataFrame, share: float, cap: int, weights: tuple, tilts: tuple, doc_id: str, text: str, source: str) -> DataFrame:
    """``training_mix`` with the column ``__row`` of ``docs``, by which rows of equal id and size follow each other."""
    rows = docs.select("__row", F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"))
    key = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    rows = cut(rows.withColumn("key", F.substring(key, 1, 16)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, weights, tilts)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").alias("b")
    s = sources.alias("s")
    b = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "bucket", "ahead", "source_size", "target", "tilt").alias("b")
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).alias("r")
    placed = placed.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
    placed = placed.select("__row", "doc_id", "size", "source_size", "target", "tilt", (F.col("ahead") + F.col("within")).alias("start"))
    wanted = F.round("target").cast("long")
    starts = [F.col("start") + k * F.col("source_size") for k in range(cap)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), wanted - at)).cast("long") for at in starts]
    places = [F.when(take > 0, position(at / F.col("target"), F.col("tilt"))).alias(f"position_{k}") for k, (at, take) in enumerate(zip(starts, takes, strict=True), 1)]
    return placed.select("__row", "doc_id", "size", "source_size", "target", sum(takes[1:], takes[0]).alias("taken"), *places)


def in_training_order(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple = WEIGHTS, tilts: tuple = TILTS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows of ``docs`` as training reads them: one for each pass that takes words of it, range-sorted by position.

    Columns stay as they are. Every row has positions of its own, whatever its id; rows that are equal in all columns
    stand as one with the positions of all. Documents of no words are taken by no pass.
    """
    cols = docs.columns
    own = docs.withColumn("__row", F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))]))
    mixed = _mix(own, share, cap, weights, tilts, doc_id, text, source)
    plan = mixed.select("__row", F.explode(F.filter(F.array(*[f"position_{k}" for k in range(1, cap + 1)]), lambda p: p.isNotNull())).alias("__at"))
    out = own.dropDuplicates(["__row"]).join(plan, "__row").select(*cols, "__at")
    return out.repartitionByRange("__at", doc_id).sortWithinPartitions("__at", doc_id).select(*cols)


def mix_sql(share: float = 1.5) -> str:
    """The same mix of ``documents`` in DuckDB SQL, with plain running sums."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
             CASE rk % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS tilt, source_size * 2 AS most FROM r),
q AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, ({share}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                 - CAST(coalesce(sum(most) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
               / CAST(sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM q),
m AS (SELECT *, max(CASE WHEN ratio > lv THEN lv END) OVER () AS lev FROM l),
t AS (SELECT source, source_size, tilt, coalesce(least(CAST(most AS DOUBLE), weight * lev), CAST(most AS DOUBLE)) AS target FROM m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt, CAST(round(t.target) AS BIGINT) AS wanted,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s1
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, wanted - s1)) AS t1, greatest(0, least(size, wanted - s1 - source_size)) AS t2 FROM p)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
       CASE WHEN t1 > 0 THEN round(CASE WHEN tilt = 0 THEN s1 / target
            ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (s1 / target))) / (2 * tilt) END, 6) END AS position_1,
       CASE WHEN t2 > 0 THEN round(CASE WHEN tilt = 0 THEN (s1 + source_size) / target
            ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * ((s1 + source_size) / target))) / (2 * tilt) END, 6) END AS position_2
FROM k"""
