"""Scans, order statistics, decoding and retrieval in blocks, against plain windows, sequential decoding and all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from geotrail.config import Costs
from geotrail.operators import decoding, decoding_blocks, raster, retrieval, retrieval_index, scans


@pytest.fixture(scope="module")
def flights(spark):
    """Two long flights, a short one, one without a value, and a null flight, with gaps at both ends."""
    rng = np.random.default_rng(4)
    rows = []
    for name, n in (("a", 2500), ("b", 999), ("c", 1), ("d", 40), (None, 30)):
        for i in range(n):
            x = None if name == "d" or rng.random() < 0.6 or i < 5 else float(i)
            rows.append((name, i, float(i), x, float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "dataset_id string, frame_count long, start_seconds double, x double, y double").repartition(5, F.xxhash64("y", "frame_count")).cache()


def along():
    return Window.partitionBy("dataset_id").orderBy("start_seconds", "frame_count")


def table(df, *cols):
    return sorted([tuple(r) for r in df.select("dataset_id", "frame_count", *cols).collect()], key=str)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scans_do_not_depend_on_blocks(flights, size):
    before, after = along().rowsBetween(Window.unboundedPreceding, 0), along().rowsBetween(0, Window.unboundedFollowing)
    plain = flights.withColumn("f", F.last("x", True).over(before)).withColumn("b", F.first("x", True).over(after)).withColumn("s", F.sum("y").over(before))
    b = scans.in_blocks(flights, size)
    b = scans.running_sum(scans.fill_backward(scans.fill_forward(b, ["x"], "_f"), ["x"], "_b"), ["y"])
    assert table(b, "x_f", "x_b", "y_sum") == table(plain, "f", "b", "s")
    assert b.agg(F.max(F.size(F.array("block")))).first()[0] == 1 and b.groupBy("dataset_id", "block").count().agg(F.max("count")).first()[0] <= size


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_neighbours_reach_over_borders(flights, size):
    plain = flights.withColumn("p", F.lag("y", 3).over(along())).withColumn("n", F.lead("y", 2).over(along()))
    b = scans.with_neighbours(scans.in_blocks(flights, size), 3, 2, size)
    b = b.withColumn("p", scans.neighbour("y", -3)).withColumn("n", scans.neighbour("y", 2)).where("own")
    assert table(b, "p", "n") == table(plain, "p", "n")


def test_places_of_equal_rows(spark):
    same = spark.range(1000).select(F.lit("a").alias("dataset_id"), F.lit(1).alias("v"))
    assert sorted(r.place for r in scans.numbered(same, ["dataset_id"], ["v"]).collect()) == list(range(1000))
    assert scans.numbered(same.limit(0), ["dataset_id"], ["v"]).count() == 0


def test_order_statistics_of_hot_and_small_groups(spark):
    rng = np.random.default_rng(9)
    data = [("hot", float(x)) for x in rng.integers(0, 20, 3000)] + [("few", 5.0), ("few", 1.0), ("one", 2.0), ("null", None), (None, 7.0), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, x double")
    shares = (0.5, 0.9)
    got = scans.order_statistics(df, ["g"], "x", shares)
    got = {r.g: r for r in got.select("g", "n", *[scans.linear_of(i, s).alias(f"q{i}") for i, s in enumerate(shares)], "at_0", "at_1").collect()}
    assert set(got) == {"hot", "few", "one", None}
    for g, r in got.items():
        v = np.sort([x for k, x in data if k == g and x is not None])
        assert r.n == len(v) and [r.q0, r.q1] == pytest.approx(np.quantile(v, shares).tolist())
        assert [r.at_0, r.at_1] == [v[int(s * len(v))] for s in shares]
    whole = scans.order_statistics(df, [], "x", (0.5,)).select("n", scans.linear_of(0, 0.5).alias("q")).first()
    assert whole.q == np.median([x for _, x in data if x is not None])


# --- decoding


def candidates(spark, flights, seed=0, exact=True):
    """Costs with few bits, so that sums are exact in any order and ties are frequent."""
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in flights:
        for step in range(n):
            for rank in range(1, 1 + int(rng.integers(2, 5))):
                u = float(rng.integers(0, 4)) if exact else float(rng.normal())
                x, y = (0.0, 0.0) if exact else rng.normal(scale=40, size=2).tolist()
                rows.append((name, step, rank, u, x, y))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["dataset_id", "step", "rank", "unary", "x_m", "y_m"]))


SIZES = (("a", 57), ("b", 1), ("c", 2), ("d", 3), ("e", 16), ("f", 17), ("g", 18), ("h", 19))


@pytest.mark.parametrize("order", [1, 2])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("block", [3, 8])
def test_blocks_decode_like_one_task(spark, order, exact, block):
    c = candidates(spark, SIZES, 3, exact)
    cfg = Costs(direction_weight=0.5)
    assert sorted(map(tuple, decoding_blocks.decode_blocks(c, order, cfg, block).collect())) == sorted(map(tuple, decoding.decode(c, order, cfg).collect()))


def test_no_candidates(spark):
    assert decoding_blocks.decode_blocks(candidates(spark, SIZES).limit(0)).count() == 0


@pytest.mark.parametrize("lag", [0, 1, 3, 50])
def test_online_decoder_resumes_from_its_state(lag):
    rng = np.random.default_rng(lag)
    unary = [rng.integers(0, 3, int(rng.integers(1, 5))).astype(float) for _ in range(40)]
    xy = [rng.normal(scale=30, size=(len(u), 2)) for u in unary]
    for n in (1, 2, 3, 7, 40):
        d, out = decoding.OnlineDecoder(lag, Costs()), []
        for u, p in zip(unary[:n], xy[:n], strict=True):
            d = decoding.OnlineDecoder.of(lag, Costs(), d.state())
            out += d.push(u, p)
            assert len(d.parents) <= max(lag - 1, 0)
        out += d.finish()
        assert len(out) == n
        if n > 2:
            assert out == decoding.second_order(unary[:n], xy[:n], Costs(), lag)


# --- retrieval


def clustered(spark, n, clusters=40, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[rng.integers(0, clusters, n)] + rng.normal(scale=spread / 4, size=(n, 16))
    v[: n // 20] = v[0]  # copies: ties
    return v


def test_index_finds_what_all_pairs_find(spark):
    refs, queries = clustered(spark, 6000), clustered(spark, 120)
    r = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(refs)], "r long, v array<double>, ord long").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q long, v array<double>")
    found = retrieval_index.search(q, r, 10, pivots=64)
    tops = {(x.q, x["rank"]): (x.r, x.sim) for x in found.tops.collect()}
    sims = queries @ refs.T
    for i, row in enumerate(sims):
        want = np.lexsort((-np.arange(len(row)), -np.round(row, 12)))[:10]
        assert [tops[i, k + 1][0] for k in range(10)] == want.tolist() or [tops[i, k + 1][1] for k in range(10)] == pytest.approx(row[want].tolist(), abs=1e-12)
    pairs = found.work.agg(F.sum("pairs"), F.count("*")).first()
    assert pairs[1] == 120 and pairs[0] < 0.25 * 120 * 6000
    assert retrieval_index.search(q, r.limit(0), 3).tops.count() == 0
    assert retrieval_index.search(q, r.limit(2), 3).tops.count() == 240


def test_index_on_vectors_without_clusters(spark, monkeypatch):
    """Where bounds rule nothing out all pairs are multiplied, and the result is the same."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 24))
    r = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "r long, v array<double>, ord long")
    q = r.limit(20).select(F.col("r").alias("q"), "v")
    mine = sorted((a.q, a["rank"], a.r) for a in retrieval_index.search(q, r, 5).tops.collect())
    plain = retrieval.top_references(q.withColumn("t", F.lit(0.0)), r.withColumn("t", F.lit(0.0)), 5)
    assert mine == sorted((a.q, a["rank"], a.r) for a in plain.collect())
    monkeypatch.setattr(retrieval, "REFERENCE_SHARD", 100)  # more references than a shard holds go to the index
    large = retrieval.top_references(q.withColumn("t", F.lit(0.0)), r.withColumn("t", F.lit(0.0)), 5)
    assert mine == sorted((a.q, a["rank"], a.r) for a in large.collect())


# --- raster


def test_rows_of_a_view_equal_its_positions(spark):
    f = spark.createDataFrame([(1, 50.0, 45.0, 30.0), (2, 20.0, 90.0, 200.0), (3, 10.0, 0.0, 0.0), (4, None, 45.0, 0.0), (5, 30.0, 5.0, 359.0)], "k long, altitude double, angle double, heading double")
    plain = {(r.k, r.row, r.col): (r.map_x, r.map_y) for r in raster.sampling_grid(f.where("altitude is not null"), size=8, gsd_m=20.0).collect()}
    rows = raster.grid_rows(f, ["k"], size=8, gsd_m=20.0).collect()
    assert len(rows) == 4 * 8
    for r in rows:
        want = [plain[r.k, r.row, c] for c in range(8)]
        assert r.map_x == pytest.approx([w[0] for w in want], rel=1e-9, abs=1e-6) and r.map_y == pytest.approx([w[1] for w in want], rel=1e-9, abs=1e-6)
        inside = [w for w in want if 0 <= w[0] < 1920 and 0 <= w[1] < 1080]
        assert r.n_inside == len(inside) and r.sum_x == pytest.approx(sum(w[0] for w in inside))
    seen = raster.view_coverage(raster.grid_rows(f, ["k"], arrays=False), ["k"]).collect()
    assert {r.k for r in seen} == {1, 2, 3, 5} and all(r.n_ahead <= 512 * 512 for r in seen)


def test_summaries_without_positions_are_the_same(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.uniform(5, 150)), float(rng.uniform(5, 95)), float(rng.uniform(0, 360))) for i in range(80)] + [(100 + i, 40.0, a, h) for i, (a, h) in enumerate((a, h) for a in (45.0, 90.0, 60.0) for h in (0.0, 90.0, 180.0, 45.0))]
    f = spark.createDataFrame(rows, "k long, altitude double, angle double, heading double")
    slim = {(r.k, r.row): r for r in raster.grid_rows(f, ["k"], size=128, gsd_m=2.0, arrays=False).collect()}
    full = raster.grid_rows(f, ["k"], size=128, gsd_m=2.0).drop("map_x", "map_y").collect()
    assert len(full) == len(slim) == 92 * 128 and sum(r.n_inside for r in full) > 10_000
    for r in full:
        s = slim[r.k, r.row]
        assert (s.n_ahead, s.n_inside) == (r.n_ahead, r.n_inside) and s.sum_x == pytest.approx(r.sum_x, rel=1e-9, abs=1e-6) and s.sum_y == pytest.approx(r.sum_y, rel=1e-9, abs=1e-6)


def test_inliers_at_the_threshold_and_at_infinity(spark):
    move = [1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.1, 0.0, 1.0]
    at = lambda x, y, dx: (float(x), float(y), (x + 2) / (0.1 * x + 1) + dx, y / (0.1 * x + 1))
    points = [at(0, 0, 0.0), at(0, 5, 4.0), at(0, 5, 4.000001), (-10.0, 1.0, 0.0, 0.0), (None, 1.0, 2.0, 3.0), (float("nan"), 1.0, 2.0, 3.0)]
    df = spark.createDataFrame([(1, points, move), (2, points[:3], move), (3, [], move), (4, None, move), (5, points, None)], "k int, p array<struct<x0:double,y0:double,x1:double,y1:double>>, h array<double>")
    got = {r.k: (r.mask, r.n_matches, r.inliers) for r in raster.with_inliers(df, "p", "h", 4.0).collect()}
    assert got[1] == ([True, True, False, False, False, False], 6, 2)
    assert got[2] == ([False] * 3, 3, 0) and got[3] == ([], 0, 0) and got[4] == ([], 0, 0) and got[5][2] == 0
