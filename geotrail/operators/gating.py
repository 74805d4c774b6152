"""Confidence gate: policies of thresholds, their summaries, the best one, and the decisions it makes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import Gate
from ..functions import stats
from .sequence import FLIGHT, along, since_last

POLICY = ("grid_ord", "max_rank", "min_inliers", "min_ratio", "min_similarity")


@dataclass(frozen=True)
class Grid:
    """All combinations of thresholds, numbered in nesting order: a policy is found from its number."""

    ranks: tuple = config.RANKS
    inliers: tuple = config.INLIERS
    ratios: tuple = config.RATIOS
    similarities: tuple = config.SIMILARITIES

    @property
    def parts(self) -> tuple[tuple, ...]:
        return self.ranks, self.inliers, self.ratios, self.similarities

    def numbers(self) -> Column:
        n = 1
        for p in self.parts:
            n *= len(p)
        return F.sequence(F.lit(0), F.lit(n - 1))

    def policy(self, number: Column) -> Column:
        fields, step = [], 1
        for name, values in zip(POLICY[:0:-1], self.parts[::-1], strict=True):
            at = F.floor(number / step).cast("int") % len(values) + 1
            fields.append(F.element_at(F.array(*[F.lit(v) for v in values]), at).alias(name))
            step *= len(values)
        return F.struct(number.alias("grid_ord"), *fields[::-1])

    def accepting(self, rows: DataFrame) -> DataFrame:
        """``rows`` once for each policy that accepts them, with its number ``grid_ord``.

        Values of one threshold after the other are tried, so a row costs what accepts it, not all combinations.
        """
        number, step = F.lit(0), 1
        for name, values in zip(POLICY[:0:-1], self.parts[::-1], strict=True):
            added = [F.when(TESTS[name](F.lit(v)), F.lit(i * step)) for i, v in enumerate(values)]
            rows = rows.withColumn(f"__{name}", F.explode(F.array(*added))).where(F.col(f"__{name}").isNotNull())
            number, step = number + F.col(f"__{name}"), step * len(values)
        return rows.withColumn("grid_ord", number).drop(*[f"__{name}" for name in POLICY])


#: What each threshold asks of a row.
TESTS = {
    "max_rank": lambda x: F.col("rank") <= x, "min_inliers": lambda x: F.col("lg_inlier_count") >= x,
    "min_ratio": lambda x: F.col("lg_inlier_ratio") >= x, "min_similarity": lambda x: F.col("sim") >= x,
}


def accepts(p: dict[str, Column]) -> Column:
    return reduce(and_, (test(p[name]) for name, test in TESTS.items()))


def policy_summaries(rows: DataFrame, grid: Grid = Grid(), cfg: Gate = Gate()) -> DataFrame:
    """One row per flight and policy. ``rows``: dataset_id, start_seconds, frame_count, rank, lg_*, sim, error_m.

    Each row goes on only under the policies that accept it; gaps include those before the first and after the last fix.
    """
    span = rows.groupBy(FLIGHT).agg(F.count("*").alias("total_frames"), F.min("start_seconds").alias("t0"), F.max("start_seconds").alias("t1"))
    hits = grid.accepting(rows).select(FLIGHT, "start_seconds", "frame_count", "error_m", "grid_ord")
    w = Window.partitionBy(FLIGHT, "grid_ord").orderBy("start_seconds", "frame_count")
    hits = hits.withColumn("gap", F.col("start_seconds") - F.lag("start_seconds").over(w))
    e = F.col("error_m")
    agg = hits.groupBy(FLIGHT, "grid_ord").agg(
        F.count("*").alias("n"), F.avg(e).alias("mean_error_m"), stats.linear(e, 0.5).alias("median_error_m"), stats.linear(e, 0.9).alias("p90_error_m"), F.max(e).alias("max_error_m"),
        F.count_if(e <= cfg.good_error_m).alias("good_fixes"), F.avg("gap").alias("mean_gap_s"), stats.linear(F.col("gap"), 0.5).alias("median_gap_s"), F.max("gap").alias("max_gap"), F.min("start_seconds").alias("f0"), F.max("start_seconds").alias("f1"))
    policies = span.withColumn("k", F.explode(grid.numbers())).withColumn("p", grid.policy(F.col("k"))).select(FLIGHT, "total_frames", "t0", "t1", "p.*")
    out = policies.join(agg, [FLIGHT, "grid_ord"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("good_fixes", F.coalesce("good_fixes", F.lit(0)))
    longest = F.coalesce(F.greatest(F.col("f0") - F.col("t0"), F.col("t1") - F.col("f1"), "max_gap"), F.col("t1") - F.col("t0"))
    return out.select(
        FLIGHT, *POLICY, "total_frames", F.col("n").alias("accepted_fixes"), (F.col("n") / F.col("total_frames")).alias("coverage"), "mean_error_m", "median_error_m", "p90_error_m", "max_error_m", "good_fixes",
        (F.col("n") - F.col("good_fixes")).alias("false_fixes"), (F.col("good_fixes") / F.greatest("n", F.lit(1))).alias("good_rate"), (F.col("good_fixes") / F.col("total_frames")).alias("good_rate_all"), "mean_gap_s", "median_gap_s", longest.alias("longest_gap_s"))


def best_policies(summaries: DataFrame, cfg: Gate = Gate()) -> DataFrame:
    """Per flight the policy of the best score, the first of equals; those below the limits rank behind all others."""
    bad = (F.col("coverage") < cfg.min_coverage) | (F.col("longest_gap_s") > cfg.max_gap_s)
    n = -F.col("longest_gap_s")
    score = F.struct(
        F.when(bad, -1.0).otherwise(F.col("good_rate")).alias("a"), F.when(bad, n).otherwise(F.col("good_rate_all")).alias("b"), F.when(bad, F.col("coverage")).otherwise(n).alias("c"),
        F.when(bad, 0.0).otherwise(F.col("coverage")).alias("d"), (-F.col("grid_ord")).alias("e"))
    every = [c for c in summaries.columns if c != FLIGHT]
    return summaries.groupBy(FLIGHT).agg(F.max_by(F.struct(*every), score).alias("p")).select(FLIGHT, "p.*")


def decisions(rows: DataFrame, policy: dict, cfg: Gate = Gate()) -> DataFrame:
    """FIX or NO_FIX of each row under one policy, with the time since the previous fix."""
    p = {k: F.lit(v) for k, v in policy.items()}
    fix = accepts(p)
    return rows.withColumn("is_fix", fix).select(
        FLIGHT, "frame_count", "start_seconds", F.when(F.col("is_fix"), "FIX").otherwise("NO_FIX").alias("decision"), since_last(F.col("is_fix")).alias("seconds_since_previous_fix"),
        "error_m", (F.col("is_fix") & (F.col("error_m") <= cfg.good_error_m)).alias("is_good_fix"))


def fix_gaps(fixes: DataFrame) -> DataFrame:
    return fixes.withColumn("gap_s", F.col("start_seconds") - F.lag("start_seconds").over(along()))
