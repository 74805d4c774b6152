"""Queries over frames and candidates: retrieval, re-ranking costs, decoding, gating and pooling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import decoding, decoding_blocks, fusion, gating, pooling, retrieval, retrieval_index
from ..sources import match_store
from ..sources.scratch import shared_folder
from . import oracle as o
from . import views
from .registry import query, rounded, rounded_sql

B = o.BASE
TOP = f"{B}, t AS (SELECT * FROM ranked WHERE rank <= 10)"


@query(f"{TOP} SELECT q, r, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim, round(error_m, 6) AS error_m FROM t")
def retrieval_cross_topk(spark, sf):
    return views.top_candidates(spark, sf, 10).select("q", "r", "rank", F.round("sim", 6).alias("sim"), F.round("error_m", 6).alias("error_m"))


@query(f"{TOP} SELECT q, r, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM t")
def retrieval_indexed(spark, sf):
    f = views.frames(spark, sf)
    q, r = f.where("role = 'query'").select(F.col("frame_count").alias("q"), "v"), f.where("role = 'reference'").select(F.col("frame_count").alias("r"), "v", F.col("frame_count").alias("ord"))
    return retrieval_index.search(q, r, 10).tops.select("q", "r", "rank", F.round("sim", 6).alias("sim"))


RES = f"{TOP}, res AS (SELECT q AS query_frame_count, arg_min(r, rank) AS reference_frame_count, arg_min(r_dataset, rank) AS reference_dataset, arg_min(sim, rank) AS similarity, count(*) AS top_k, min(error_m) AS oracle_top_k_error_m, arg_min(r_lat, rank) AS estimated_ground_latitude, arg_min(r_lon, rank) AS estimated_ground_longitude, arg_min(error_m, rank) AS position_error_m FROM t GROUP BY q)"
_cols = ("query_frame_count reference_frame_count reference_dataset top_k", "similarity oracle_top_k_error_m position_error_m", "estimated_ground_latitude estimated_ground_longitude")


@query(f"{RES} SELECT {rounded_sql(*_cols)} FROM res")
def oracle_topk(spark, sf):
    return rounded(retrieval.retrieval_results(views.top_candidates(spark, sf, 10)), *_cols)


_sum = ", ".join(f"round({e}, 6) AS {n}" for n, e in (("mean_error_m", "avg(position_error_m)"), ("median_error_m", "quantile_cont(position_error_m, 0.5)"), ("p90_error_m", "quantile_cont(position_error_m, 0.9)"), ("max_error_m", "max(position_error_m)"), ("oracle_mean_error_m", "avg(oracle_top_k_error_m)"), ("oracle_median_error_m", "quantile_cont(oracle_top_k_error_m, 0.5)")))


@query(f"{RES} SELECT count(*) AS queries, {_sum} FROM res")
def retrieval_summary(spark, sf):
    s = retrieval.retrieval_summary(retrieval.retrieval_results(views.top_candidates(spark, sf, 10)))
    return rounded(s, "queries", " ".join(c for c in s.columns if c != "queries"))


@query(f"{RES} SELECT reference_dataset, count(*) AS hits FROM res GROUP BY 1")
def reference_hits(spark, sf):
    return retrieval.retrieval_results(views.top_candidates(spark, sf, 10)).groupBy("reference_dataset").agg(F.count("*").alias("hits"))


_one = f"{B}, f AS (SELECT *, row_number() OVER (ORDER BY frame_count) - 1 AS i FROM fr), s AS (SELECT q.frame_count AS q, r.frame_count AS r, list_dot_product(q.v, r.v) AS sim, abs(q.start_seconds - r.start_seconds) AS gap FROM f q JOIN f r ON q.i % 5 <> 0 AND r.i % 5 = 0)"


def _strided(spark, sf) -> tuple[DataFrame, DataFrame]:
    # frames are numbered without a gap, so the number is the ordinal
    return retrieval.split_by_stride(views.frames(spark, sf), 5, "frame_count")


@query(f"{_one}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r DESC) AS rank FROM s) SELECT q, r, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM k WHERE rank <= 5")
def retrieval_stride(spark, sf):
    refs, queries = _strided(spark, sf)
    return views.top_candidates(spark, sf, 5, refs=refs, queries=queries).select("q", "r", "rank", F.round("sim", 6).alias("sim"))


@query(f"{_one}, a AS (SELECT *, max(gap <= 2) OVER (PARTITION BY q) AS near FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r DESC) AS rank FROM a WHERE gap <= 2 OR NOT near) SELECT q, r, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM k WHERE rank <= 5")
def retrieval_time_gap(spark, sf):
    refs, queries = _strided(spark, sf)
    return views.top_candidates(spark, sf, 5, 2.0, refs=refs, queries=queries).select("q", "r", "rank", F.round("sim", 6).alias("sim"))


def _steps(spark, sf) -> DataFrame:
    c = decoding.numbered_steps(decoding.with_unary(views.candidates(spark, sf)))
    x, y = geo.local_xy("r_lat", "r_lon", views.LAT0, views.LON0)
    return c.withColumn("x_m", x).withColumn("y_m", y)


@query(f"{B} SELECT q, r, round(unary, 6) AS unary FROM cu")
def unary_cost(spark, sf):
    return _steps(spark, sf).select("q", "r", F.round("unary", 6).alias("unary"))


@query(f"{B} SELECT b.dataset_id, b.step, CAST(a.rank AS INTEGER) AS prev_rank, CAST(b.rank AS INTEGER) AS rank, round({o.step_sql('a', 'b')}, 5) AS step_cost FROM cu a JOIN cu b ON a.dataset_id = b.dataset_id AND b.step = a.step + 1")
def pair_costs(spark, sf):
    return decoding.pair_costs(_steps(spark, sf)).withColumn("step_cost", F.round("step_cost", 5))


VIT = f"""{B}, v(dataset_id, step, rank, cost, path) AS (
  SELECT dataset_id, step, rank, unary, [CAST(rank AS INTEGER)] FROM cu WHERE step = 0
  UNION ALL
  SELECT dataset_id, step, rank, min(c), arg_min(path, struct_pack(a := c, b := pr)) FROM (
    SELECT b.dataset_id, b.step, b.rank, v.cost + b.unary + {o.step_sql('a', 'b')} AS c, list_append(v.path, CAST(b.rank AS INTEGER)) AS path, v.rank AS pr
    FROM v JOIN cu a ON a.dataset_id = v.dataset_id AND a.step = v.step AND a.rank = v.rank JOIN cu b ON b.dataset_id = v.dataset_id AND b.step = v.step + 1) GROUP BY dataset_id, step, rank),
e AS (SELECT dataset_id, arg_min(path, struct_pack(a := cost, b := rank)) AS path FROM v WHERE len(path) = (SELECT max(step) + 1 FROM cu WHERE cu.dataset_id = v.dataset_id) GROUP BY dataset_id)"""


@query(f"{VIT} SELECT dataset_id, CAST(unnest(range(0, len(path))) AS BIGINT) AS step, unnest(path) AS rank FROM e")
def viterbi1(spark, sf):
    return decoding.decode(_steps(spark, sf), order=1)


_bend = "1.0::DOUBLE * pow(sqrt(pow((c.x_m - b.x_m) - (b.x_m - a.x_m), 2) + pow((c.y_m - b.y_m) - (b.y_m - a.y_m), 2)) / 20.0::DOUBLE, 2)"
VIT2 = f"""{B}, v(dataset_id, step, r1, r2, cost, path) AS (
  SELECT a.dataset_id, b.step, a.rank, b.rank, a.unary + b.unary + {o.step_sql('a', 'b')}, [CAST(a.rank AS INTEGER), CAST(b.rank AS INTEGER)] FROM cu a JOIN cu b ON a.dataset_id = b.dataset_id AND a.step = 0 AND b.step = 1
  UNION ALL
  SELECT dataset_id, step, r1, r2, min(k), arg_min(path, struct_pack(a := k, b := pr)) FROM (
    SELECT c.dataset_id, c.step, v.r2 AS r1, c.rank AS r2, v.cost + c.unary + {o.step_sql('b', 'c')} + {_bend} AS k, list_append(v.path, CAST(c.rank AS INTEGER)) AS path, v.r1 AS pr
    FROM v JOIN cu a ON a.dataset_id = v.dataset_id AND a.step = v.step - 1 AND a.rank = v.r1 JOIN cu b ON b.dataset_id = v.dataset_id AND b.step = v.step AND b.rank = v.r2
      JOIN cu c ON c.dataset_id = v.dataset_id AND c.step = v.step + 1) GROUP BY dataset_id, step, r1, r2),
e AS (SELECT dataset_id, arg_min(path, struct_pack(a := cost, b := r1, c := r2)) AS path FROM v WHERE len(path) = (SELECT max(step) + 1 FROM cu WHERE cu.dataset_id = v.dataset_id) GROUP BY dataset_id)"""


@query(f"{VIT2} SELECT dataset_id, CAST(unnest(range(0, len(path))) AS BIGINT) AS step, unnest(path) AS rank FROM e")
def viterbi2(spark, sf):
    return decoding.decode(_steps(spark, sf), order=2)


@query(f"{VIT} SELECT dataset_id, CAST(unnest(range(0, len(path))) AS BIGINT) AS step, unnest(path) AS rank FROM e")
def viterbi1_blocks(spark, sf):
    return decoding_blocks.decode_blocks(_steps(spark, sf), order=1, block=16)


@query(f"{VIT2} SELECT dataset_id, CAST(unnest(range(0, len(path))) AS BIGINT) AS step, unnest(path) AS rank FROM e")
def viterbi2_blocks(spark, sf):
    return decoding_blocks.decode_blocks(_steps(spark, sf), order=2, block=16)


#: A frame's choice lies on the best path of three steps later, or on that of the end.
ONLINE_SQL = f"""{VIT2}, n AS (SELECT dataset_id, max(step) + 1 AS n FROM cu GROUP BY dataset_id),
b AS (SELECT dataset_id, step, arg_min(path, struct_pack(a := cost, b := r1, c := r2)) AS path FROM v GROUP BY dataset_id, step),
f AS (SELECT dataset_id, CAST(unnest(range(0, n)) AS BIGINT) AS step, n FROM n)
SELECT f.dataset_id, f.step, b.path[f.step + 1] AS rank FROM f JOIN b ON b.dataset_id = f.dataset_id AND b.step = least(f.step + 3, n - 1)"""


@query(ONLINE_SQL)
def viterbi_online(spark, sf):
    return decoding.decode(_steps(spark, sf), order=2, lag=3)


@query(f"{VIT}, p AS (SELECT dataset_id, CAST(unnest(range(0, len(path))) AS BIGINT) AS step, unnest(path) AS rank FROM e), x AS (SELECT f.error_m AS b, g.error_m AS a FROM p JOIN cu g USING (dataset_id, step, rank) JOIN cu f ON f.dataset_id = p.dataset_id AND f.step = p.step AND f.rank = 1) SELECT count(*) AS queries, count(*) FILTER (a < b) AS improved, count(*) FILTER (a > b) AS worsened, count(*) FILTER (a = b) AS unchanged FROM x")
def improved_worsened(spark, sf):
    c = _steps(spark, sf)
    chosen = decoding.decode(c, order=1)
    after = c.join(chosen, ["dataset_id", "step", "rank"]).select("dataset_id", "step", F.col("error_m").alias("after_m"))
    before = c.where("rank = 1").select("dataset_id", "step", F.col("error_m").alias("before_m"))
    return decoding.improvement_counts(before.join(after, ["dataset_id", "step"]), "before_m", "after_m")


# --- gate: rows are the best candidate of each frame under a tenth of a policy, so that all outcomes occur


def _gate_rows(spark, sf) -> DataFrame:
    c = views.candidates(spark, sf, 1)  # no candidate but the best is searched
    return c.select("dataset_id", F.col("q").alias("frame_count"), F.col("q").cast("double").alias("start_seconds"), (F.col("q") % 6 + 1).alias("rank"), "lg_inlier_count", (F.col("q") % 100 / 100).alias("lg_inlier_ratio"), (0.9 + F.col("q") % 10 / 100).alias("sim"), "error_m")


GATE = f"{B}, gr AS (SELECT dataset_id, q AS frame_count, CAST(q AS DOUBLE) AS start_seconds, q % 6 + 1 AS rank, lg_inlier_count, CAST(q % 100 AS DOUBLE) / 100 AS lg_inlier_ratio, 0.9::DOUBLE + CAST(q % 10 AS DOUBLE) / 100 AS sim, error_m FROM cand WHERE cand.rank = 1)"
_acc = "gr.rank <= max_rank AND lg_inlier_count >= min_inliers AND lg_inlier_ratio >= min_ratio AND sim >= min_similarity"
SUMS = f"""{GATE}, {o.grid_sql()}, span AS (SELECT dataset_id, count(*) AS total_frames, min(start_seconds) AS t0, max(start_seconds) AS t1 FROM gr GROUP BY 1),
h AS (SELECT gr.*, grid_ord, start_seconds - lag(start_seconds) OVER (PARTITION BY dataset_id, grid_ord ORDER BY start_seconds, frame_count) AS gap FROM gr JOIN g ON {_acc}),
a AS (SELECT dataset_id, grid_ord, count(*) AS n, avg(error_m) AS mean_error_m, quantile_cont(error_m, 0.5) AS median_error_m, quantile_cont(error_m, 0.9) AS p90_error_m, max(error_m) AS max_error_m, count(*) FILTER (error_m <= 200) AS good_fixes,
  avg(gap) AS mean_gap_s, quantile_cont(gap, 0.5) AS median_gap_s, max(gap) AS mg, min(start_seconds) AS f0, max(start_seconds) AS f1 FROM h GROUP BY 1, 2),
sm AS (SELECT span.dataset_id, g.*, total_frames, coalesce(n, 0) AS accepted_fixes, CAST(coalesce(n, 0) AS DOUBLE) / total_frames AS coverage, mean_error_m, median_error_m, p90_error_m, max_error_m, coalesce(good_fixes, 0) AS good_fixes,
  coalesce(n, 0) - coalesce(good_fixes, 0) AS false_fixes, CAST(coalesce(good_fixes, 0) AS DOUBLE) / greatest(coalesce(n, 0), 1) AS good_rate, CAST(coalesce(good_fixes, 0) AS DOUBLE) / total_frames AS good_rate_all, mean_gap_s, median_gap_s,
  CASE WHEN n IS NULL THEN t1 - t0 ELSE greatest(f0 - t0, t1 - f1, coalesce(mg, 0)) END AS longest_gap_s FROM span CROSS JOIN g LEFT JOIN a USING (dataset_id, grid_ord))"""
_scols = ("dataset_id grid_ord max_rank min_inliers min_ratio min_similarity total_frames accepted_fixes good_fixes false_fixes", "coverage mean_error_m median_error_m p90_error_m max_error_m good_rate good_rate_all mean_gap_s median_gap_s longest_gap_s")
CFG = gating.Gate(good_error_m=200.0, min_coverage=0.1, max_gap_s=150.0)


@query(f"{SUMS} SELECT {rounded_sql(*_scols)} FROM sm")
def gate_policy_summary(spark, sf):
    return rounded(gating.policy_summaries(_gate_rows(spark, sf), cfg=CFG), *_scols)


@query(f"""{SUMS}, b AS (SELECT *, coverage < 0.1::DOUBLE OR longest_gap_s > 150 AS bad FROM sm)
SELECT {rounded_sql(*_scols)} FROM b QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY CASE WHEN bad THEN -1 ELSE good_rate END DESC, CASE WHEN bad THEN -longest_gap_s ELSE good_rate_all END DESC,
  CASE WHEN bad THEN coverage ELSE -longest_gap_s END DESC, CASE WHEN bad THEN 0 ELSE coverage END DESC, grid_ord) = 1""")
def gate_sweep_best(spark, sf):
    return rounded(gating.best_policies(gating.policy_summaries(_gate_rows(spark, sf), cfg=CFG), CFG), *_scols)


@query(f"""{GATE}, d AS (SELECT *, gr.rank <= 4 AND lg_inlier_count >= 50 AND lg_inlier_ratio >= 0.2::DOUBLE AND sim >= 0.91::DOUBLE AS fix FROM gr),
l AS (SELECT *, last_value(CASE WHEN fix THEN start_seconds END IGNORE NULLS) OVER (PARTITION BY dataset_id ORDER BY start_seconds, frame_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM d)
SELECT dataset_id, frame_count, CASE WHEN fix THEN 'FIX' ELSE 'NO_FIX' END AS decision, CASE WHEN fix THEN start_seconds - t END AS seconds_since_previous_fix, round(error_m, 6) AS error_m, fix AND error_m <= 200 AS is_good_fix FROM l""")
def gate_decisions(spark, sf):
    d = gating.decisions(_gate_rows(spark, sf), {"max_rank": 4, "min_inliers": 50, "min_ratio": 0.2, "min_similarity": 0.91}, CFG)
    return d.select("dataset_id", "frame_count", "decision", "seconds_since_previous_fix", F.round("error_m", 6).alias("error_m"), "is_good_fix")


# --- pooling: the frames of a dataset stand for the patches of an image


def _dims(d: DataFrame) -> DataFrame:
    return d.select("dataset_id", F.posexplode("descriptor").alias("dim", "y")).withColumn("y", F.round("y", 6))


_pd = f"{B}, p AS (SELECT dataset_id, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM fr)"
_unit = "SELECT dataset_id, CAST(dim AS INTEGER) AS dim, round(y / greatest(sqrt(sum(y * y) OVER (PARTITION BY dataset_id)), 1e-12), 6) AS y FROM m"


@query(f"{B}, n AS (SELECT frame_count, list_transform(v, lambda x: x * 3) AS v FROM fr), u AS (SELECT frame_count, unnest(v) AS x, unnest(range(0, len(v))) AS dim, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM n) SELECT frame_count, CAST(dim AS INTEGER) AS dim, round(x / greatest(norm, 1e-12), 6) + 0.0::DOUBLE AS y FROM u")
def unit_descriptors(spark, sf):
    f = views.frames(spark, sf).withColumn("v", F.transform("v", lambda x: x.cast("double") * 3))
    return rounded(f.withColumn("u", retrieval.l2_normalise("v")).select("frame_count", F.posexplode("u").alias("dim", "y")), "frame_count dim", "y")


@query(f"{_pd}, m AS (SELECT dataset_id, dim, avg(x) AS y FROM p GROUP BY 1, 2) {_unit}")
def pool_mean(spark, sf):
    return _dims(pooling.mean_pool(views.frames(spark, sf), "dataset_id", "v"))


@query(f"{_pd}, q AS (SELECT dataset_id, dim, avg(pow(x, 3)) AS a FROM p GROUP BY 1, 2), m AS (SELECT dataset_id, dim, sign(a) * pow(abs(a), 1.0::DOUBLE / 3) AS y FROM q) {_unit}")
def pool_gem(spark, sf):
    return _dims(pooling.gem_pool(views.frames(spark, sf), "dataset_id", "v"))


#: Eight centres by rule: the i-th is 1 in every dimension that leaves i modulo 8, and 0 elsewhere.
CENTRES = [[1.0 if d % 8 == i else 0.0 for d in range(64)] for i in range(8)]
_book = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in c) + "]" for c in CENTRES) + "]"


@query(f"""{B}, b AS (SELECT {_book} AS book), d AS (SELECT dataset_id, v, book, list_transform(book, lambda c: list_dot_product(c, v)) AS dots FROM fr, b),
k AS (SELECT dataset_id, v, book, list_position(dots, list_max(dots)) AS k FROM d), p AS (SELECT dataset_id, (k - 1) * 64 + i - 1 AS dim, v[i] - book[k][i] AS x FROM k, unnest(range(1, 65)) AS t(i)),
s AS (SELECT dataset_id, dim, sum(x) AS x FROM p GROUP BY 1, 2), m AS (SELECT a.dataset_id, z.dim, coalesce(x, 0) AS y FROM (SELECT DISTINCT dataset_id FROM fr) a CROSS JOIN unnest(range(0, 512)) AS z(dim) LEFT JOIN s ON s.dataset_id = a.dataset_id AND s.dim = z.dim) {_unit}""")
def vlad(spark, sf):
    return _dims(pooling.vlad(views.frames(spark, sf), CENTRES, "dataset_id", "v"))




@query(f"{B}, b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY lg_inlier_count DESC, rank) AS n FROM cand) SELECT q, r, lg_inlier_count, round(lg_inlier_ratio, 6) AS lg_inlier_ratio FROM b WHERE n = 1")
def best_by_inliers(spark, sf):
    return rounded(fusion.best_by_inliers(views.candidates(spark, sf), "q"), "q r lg_inlier_count", "lg_inlier_ratio")


def matches_by_rule(pairs: DataFrame) -> DataFrame:
    """Match scores made from the frame numbers, in the place of a matcher."""
    q, r = F.col("q"), F.col("r")
    p = pairs.withColumn("lg_match_count", (q * 31 + r * 17) % 900).withColumn("lg_mean_score", (q + r) % 10 / 10)
    p = p.withColumn("lg_inlier_count", F.floor(F.col("lg_match_count") * ((q * 7 + r * 13) % 101) / 100).cast("long"))
    return p.withColumn("lg_inlier_ratio", F.col("lg_inlier_count") / F.greatest("lg_match_count", F.lit(1)))


@query(f"{B} SELECT q, r, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim, lg_match_count, (q + r) % 10 / 10.0::DOUBLE AS lg_mean_score, lg_inlier_count, round(lg_inlier_ratio, 6) AS lg_inlier_ratio FROM cand")
def candidates_verified(spark, sf):
    f = views.frames(spark, sf)
    side = lambda role, key: f.where(f"role = '{role}'").select(F.col("frame_count").alias(key), "v", F.col("start_seconds").alias("t"))
    store = match_store.MatchStore(spark, f"{shared_folder(spark)}/matches-{uuid.uuid4().hex}")
    c = match_store.verified_candidates(side("query", "q"), side("reference", "r").withColumn("ord", F.col("r")), 6, matches_by_rule, store)
    return rounded(c, "q r rank lg_match_count lg_mean_score lg_inlier_count", "sim lg_inlier_ratio")


@query(f"{B} SELECT q, 'frame_' || r AS reference_frame_path, CASE WHEN r % 3 <> 0 THEN round(r_lat, 8) END AS ref_lat, CASE WHEN r % 3 <> 0 THEN round(r_lon, 8) END AS ref_lon FROM cand WHERE rank = 1")
def reference_by_path(spark, sf):
    path = lambda c: F.concat(F.lit("frame_"), F.col(c).cast("string"))
    refs = views.frames(spark, sf).where("role = 'reference' and frame_count % 3 <> 0").select(path("frame_count").alias("frame_path"), F.lit(0).alias("src_ord"), F.col("frame_count").alias("seq"), "ground_latitude", "ground_longitude")
    best = views.candidates(spark, sf, 1).select("q", path("r").alias("reference_frame_path"))
    return rounded(retrieval.position_by_path(best, refs), "q reference_frame_path", "", "ref_lat ref_lon")
