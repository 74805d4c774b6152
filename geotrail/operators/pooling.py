"""Image descriptors from patch descriptors: mean, generalised mean and VLAD pooling, as grouped sums per dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_dimension(patches: DataFrame, image: str, v: str) -> DataFrame:
    return patches.select(image, F.posexplode(v).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def collected(df: DataFrame, image: str, value: Column) -> DataFrame:
    """Values of all dimensions in order, scaled to unit length."""
    a = df.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("dim", value.alias("y")))).alias("d"))
    v = F.transform("d", lambda s: s["y"])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return a.select(image, F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("descriptor"))


def mean_pool(patches: DataFrame, image: str, v: str) -> DataFrame:
    d = by_dimension(patches, image, v).groupBy(image, "dim").agg(F.avg("x").alias("m"))
    return collected(d, image, F.col("m"))


def gem_pool(patches: DataFrame, image: str, v: str, p: float = 3.0) -> DataFrame:
    """Signed root of the mean of powers; with a non-integer ``p`` negative components give NaN."""
    d = by_dimension(patches, image, v).groupBy(image, "dim").agg(F.avg(F.pow("x", F.lit(float(p)))).alias("m"))
    return collected(d, image, F.signum("m") * F.pow(F.abs("m"), F.lit(1.0 / p)))


def vlad(patches: DataFrame, centres: list[list[float]], image: str, v: str) -> DataFrame:
    """Residuals summed per centre of the greatest dot product (the first of equals), at unit length over all centres.

    Centres without a patch contribute zeros. ``centres`` is a parameter of fixed size.
    """
    book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    n, dim = len(centres), len(centres[0])
    dots = F.transform(book, lambda c: F.aggregate(F.zip_with(c, F.col(v), lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x))
    own = patches.withColumn("__dots", dots).withColumn("__k", (F.array_position("__dots", F.array_max("__dots")) - 1).cast("int"))
    own = own.withColumn("__r", F.zip_with(v, F.get(book, F.col("__k")), lambda a, b: a.cast("double") - b))
    d = own.select(image, "__k", F.posexplode("__r").alias("i", "x")).groupBy(image, (F.col("__k") * dim + F.col("i")).alias("dim")).agg(F.sum("x").alias("m"))
    zeros = patches.select(image).distinct().select(image, F.explode(F.sequence(F.lit(0), F.lit(n * dim - 1))).alias("dim"), F.lit(0.0).alias("m"))
    d = d.unionByName(zeros.select(image, "dim", "m")).groupBy(image, "dim").agg(F.sum("m").alias("m"))
    return collected(d, image, F.col("m"))
