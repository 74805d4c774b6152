"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds and exact reranking.

A vector is centred, scaled to unit length and rotated at random; the signs are its code, and two scalars correct it: the
distance to the centre and the inner product of the rotated vector with its code. From the packed bits the inner product
with a query is estimated without bias, with a known spread. A query first measures the vectors that look nearest, whose
worst true distance is a limit, and then all whose bound on the distance is within that limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import append_arrow

#: Standard deviations of the estimate that the bound allows for.
SPREAD = 3.5
#: Vectors from which the centre is taken at most, by the hash order of the vector.
CENTRE_SAMPLE = 4096
#: Distinct vectors of a shard (and their components), and queries of a group, that one task holds together.
SHARD, SHARD_VALUES, GROUP = 16384, 1 << 22, 1024
SEED = 17


@dataclass
class Rotation:
    centre: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, centre: np.ndarray) -> Rotation:
        d = len(centre)
        q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
        return cls(centre, q * np.sign(np.diag(r)))

    def turn(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated unit vectors and distances to the centre."""
        away = v - self.centre
        norm = np.linalg.norm(away, axis=1)
        return (away / np.maximum(norm, 1e-300)[:, None]) @ self.matrix, norm

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, distance to the centre, and inner product of each with its code."""
        unit, norm = self.turn(v)
        return np.packbits(unit > 0, axis=1), norm, np.abs(unit).sum(axis=1) / np.sqrt(v.shape[1])


@dataclass
class Rotations:
    """The rotation of each vector length; only the most frequent one has a centre other than zero."""

    centre: np.ndarray
    made: dict[int, Rotation] = field(default_factory=dict)

    def of(self, d: int) -> Rotation:
        if d not in self.made:
            self.made[d] = Rotation.of(self.centre if d == len(self.centre) else np.zeros(d))
        return self.made[d]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Distinct (id, v, d) of rows with an id and a non-zero vector of finite components, and its length.

    Floats stay floats, which doubles hold exactly; other numbers are read as doubles.
    """
    v = F.col(vector)
    held = v if vectors.schema[vector].dataType.elementType == FloatType() else v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), held.alias("v"), F.size(v).alias("d")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def build_index(rows: DataFrame, dim: int, k: int) -> tuple[DataFrame, Rotations]:
    """Distinct vectors with the ``k + 1`` smallest ids that have each, their codes and correction scalars.

    More ids of one vector never get among the k nearest of a query, which skips at most its own.
    """
    order = Window.partitionBy("v").orderBy("id")
    classes = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("v", "d").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    some = rows.where(F.col("d") == dim).select("v").orderBy(F.xxhash64("v"), "v").limit(CENTRE_SAMPLE).toArrow()
    rotations = Rotations(matrix(some["v"], dim).mean(axis=0) if some.num_rows else np.zeros(dim))
    sent = rows.sparkSession.sparkContext.broadcast(rotations)

    def kernel(batch: pa.RecordBatch) -> list:
        lengths = batch.column(batch.schema.get_field_index("d")).to_numpy()
        codes, norms, fits = [b""] * len(lengths), np.zeros(len(lengths)), np.zeros(len(lengths))
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            code, norms[at], fits[at] = sent.value.of(d).encode(matrix(batch.column("v").take(pa.array(at)), d))
            for i, c in zip(at, code, strict=True):
                codes[i] = c.tobytes()
        return [codes, norms, fits]

    return append_arrow(classes, kernel, "code binary, norm double, fit double"), rotations


def _cell(rotations, k: int):
    """Nearest ``k + 1`` distinct vectors of a shard for each query of a group; all of one length."""

    def near(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and shard.num_rows:
            dim = queries["d"][0].as_py()
            own = rotations.value.of(dim)
            q, v = matrix(queries["v"], dim), matrix(shard["v"], dim)
            unit, q_norm = own.turn(q)
            bits = np.unpackbits(np.frombuffer(b"".join(shard["code"].to_pylist()), np.uint8).reshape(len(v), -1), axis=1, count=dim)
            signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
            norm, fit = shard["norm"].to_numpy(), np.maximum(shard["fit"].to_numpy(), 1e-9)
            slack = SPREAD * np.sqrt(np.maximum(1 - fit * fit, 0)) / (fit * np.sqrt(max(dim - 1, 1))) + 1e-5  # and that of 32-bit products
            ids, query_ids = shard["ids"].to_pylist(), queries["id"].to_pylist()
            m = min(k + 1, len(v))
            for at in range(0, len(q), 64):
                cos = (unit[at : at + 64].astype(np.float32) @ signs.T).astype(np.float64) / fit
                for j, c in enumerate(cos, at):
                    base = norm * norm + q_norm[j] ** 2
                    first = np.argpartition(base - 2 * norm * q_norm[j] * c, m - 1)[:m]
                    limit = ((v[first] - q[j]) ** 2).sum(axis=1).max()
                    low = base - 2 * norm * q_norm[j] * np.minimum(c + slack, 1.0)
                    pick = np.union1d(np.flatnonzero(~(low > limit * (1 + 1e-9) + 1e-12)), first)
                    far = np.sqrt(np.cumsum((v[pick] - q[j]) ** 2, axis=1)[:, -1])  # summed in order, as SQL does
                    worst = np.partition(far, m - 1)[m - 1]
                    for i, d in zip(pick[far <= worst], far[far <= worst], strict=True):
                        out[0].append(query_ids[j])
                        out[1].append(ids[i])
                        out[2].append(d)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.list_(pa.int64())), "score": pa.array(out[2], pa.float64())})

    return near


def nearest(vectors: DataFrame, every: int, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the k nearest other rows.

    Nearest by Euclidean distance in double precision, ties to the smaller id; all rows of the query's length if there
    are fewer. Null ids, null, empty or zero vectors and vectors with null or non-finite components take no part; vectors
    of each length are searched apart. Equal rows count once, and no row of a query's own id is its neighbour. An empty
    table gives no row.
    Equal vectors are one entry with their few smallest ids, so no group of copies is ever in one task. Each group of
    queries meets each shard of entries in a task of bounded size; shards give only their own k + 1 best.
    """
    rows = usable(vectors, vec_id, vector)
    chosen = F.pmod("id", F.lit(every)) == 0
    lengths = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum(chosen.cast("int")).alias("q"))
    size = lengths.agg(F.sum("n"), F.sum(F.col("n") * F.col("d")), F.sum("q"), F.max_by("d", F.struct("n", -F.col("d")))).first()
    n, n_values, n_queries, dim = (size[0], size[1], size[2], size[3]) if size[0] else (0, 0, 0, 1)
    index, rotations = build_index(rows, dim, k)
    shards, groups = max(1, -(-n // SHARD), -(-n_values // SHARD_VALUES)), -(-n_queries // GROUP) or 1
    queries = rows.where(chosen).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    queries = queries.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    index = index.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = vectors.sparkSession.sparkContext.broadcast(rotations)
    found = queries.groupBy("d", "g", "s").cogroup(index.groupBy("d", "g", "s")).applyInArrow(_cell(sent, k), "query_id long, ids array<long>, score double")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Brute force over ``embeddings``.
NEAREST_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.id AS query_id, c.id AS vec_id, min(sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y))) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10"""
