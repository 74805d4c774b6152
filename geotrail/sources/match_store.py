"""Verified candidates: a write-once table of match scores, so that no pair of frames is matched twice."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import top_references
from .providers import MatchProvider

SCORES = "q long, r long, lg_match_count long, lg_mean_score double, lg_inlier_count long, lg_inlier_ratio double"
KEYS = ["q", "r"]


class MatchStore:
    """Scores of pairs (q, r) in a folder that all executors share.

    Each call that finds pairs without a score has them scored, once each, and appends them as a part of its own; parts
    are never changed. Of a pair that two runs score at one time the earlier part counts. A part appears when its write is
    committed, so a run that dies leaves nothing behind that is read.
    """

    def __init__(self, spark: SparkSession, folder: str, recompute: bool = False):
        """``recompute`` starts anew: parts written before now are no longer read."""
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], SCORES).coalesce(1).write.mode("ignore").parquet(f"{folder}/part=0")
        self.since = time.time_ns() if recompute else 0

    def held(self) -> DataFrame:
        parts = self.spark.read.schema(f"{SCORES}, part long").option("basePath", self.folder).parquet(self.folder).where(F.col("part") >= self.since)
        values = [c for c in parts.columns if c not in (*KEYS, "part")]
        return parts.groupBy(*KEYS).agg(F.min_by(F.struct(*values), "part").alias("s")).select(*KEYS, "s.*")

    def scored(self, pairs: DataFrame, provider: MatchProvider) -> DataFrame:
        """``pairs`` with their scores; ``provider`` sees the distinct pairs that the store lacks, and nothing else."""
        missing = pairs.select(*KEYS).dropna().distinct().join(self.held().select(*KEYS), KEYS, "left_anti")
        if not missing.isEmpty():
            columns = [c.strip().split(" ")[0] for c in SCORES.split(",")]
            provider(missing).select(*columns).write.parquet(f"{self.folder}/part={time.time_ns()}")
        return pairs.join(self.held(), KEYS, "left")


def verified_candidates(queries: DataFrame, refs: DataFrame, k: int, provider: MatchProvider, store: MatchStore, max_gap_s: float | None = None) -> DataFrame:
    """(q, r, sim, rank) of the ``k`` most similar references of each query, with the match scores of each pair.

    For a table of queries or for one live query alike; see ``top_references`` for the tables.
    """
    return store.scored(top_references(queries, refs, k, max_gap_s), provider)
