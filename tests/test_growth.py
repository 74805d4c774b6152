"""Queries on rows that only larger tables hold, against their SQL or brute force."""

import glob
import itertools
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import plain

from geotrail.llm.components import connected_components
from geotrail.operators import gating, raster, retrieval, retrieval_index
from geotrail.plans import queries_stream, registry, views
from geotrail.sources import readers
from geotrail.streaming import ordered

REG = registry.load()


@pytest.fixture(scope="module")
def late_events(spark, sf, tmp_path_factory):
    """Events whose numbers, which are their seconds, reach the hundredth and the thousandth hour."""
    at = str(tmp_path_factory.mktemp("late"))
    e = spark.read.parquet(f"{sf}/events.parquet")
    for k, first in enumerate((359_500, 3_599_500)):
        e.withColumn("event_id", F.col("event_id") + first).write.mode("append").parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    return at, con


def same_as_sql(spark, con, at, name):
    df = REG.QUERIES[name](spark, at)
    rel = con.sql(REG.ORACLE_SQL[name])
    cols = sorted(df.columns)
    places = [rel.columns.index(c) for c in cols]
    mine = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    assert mine == sorted([tuple(plain(r[i]) for i in places) for r in rel.fetchall()], key=str) and mine
    return df


@pytest.mark.parametrize("name", ["srt_parse", "srt_time"])
def test_hours_beyond_two_digits(spark, late_events, name):
    df = same_as_sql(spark, late_events[1], late_events[0], name)
    seconds = "start_seconds" if name == "srt_parse" else "seconds"
    assert df.agg(F.max(seconds)).first()[0] > 3_600_000


def test_time_ranges_keep_all_digits_of_hours(spark):
    times = ["99:59:59,999 --> 100:00:00,001", "1000:00:01,500 --> 1000:00:02,000", "7:00:00,000 --> 08:00:00,000"]
    df = spark.createDataFrame([(f"{k + 1}\n{t}\n[iso: 1]",) for k, t in enumerate(times)], "block string")
    got = [(r.start_seconds, r.end_seconds) for r in readers.parse_blocks(df).orderBy("subtitle_index").collect()]
    assert got == [(359999.999, 360000.001), (3600001.5, 3600002.0)]


# --- retrieval


def test_few_pairs_are_multiplied_twice(monkeypatch):
    """Nearly all pairs are passed over in single precision; what that can't tell apart is decided in double precision."""
    seen, known = [], retrieval_index._exact
    monkeypatch.setattr(retrieval_index, "_exact", lambda x, refs, i, j: seen.append(len(i)) or known(x, refs, i, j))
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 64)), rng.normal(size=(9000, 64))
    y[10:400:3] = y[7] * (1 + rng.permutation(130)[:, None] * 1e-12)  # equal in single precision
    x[0], order, s = y[7], rng.permutation(9000), x @ y.T
    s[0] = y @ y[7]
    for scale in (1.0, 1e-30, 1e20):
        seen.clear()
        i, j, sim = retrieval_index.largest(x * scale, y * scale, order, 6)
        for q in range(40):
            assert j[i == q].tolist() == np.lexsort((-order, -np.einsum("j,ij->i", x[q], y)))[:6].tolist()
        assert np.allclose(sim, s[i, j] * scale**2, rtol=1e-9, atol=0)
        assert scale != 1.0 or sum(seen) < 40 * 20


@pytest.mark.parametrize(("rows", "refs", "piece"), [(256, 4096, 1 << 15), (7, 13, 5), (1, 3, 1)])
def test_largest_products_in_tiles(monkeypatch, rows, refs, piece):
    for name, v in (("TILE_ROWS", rows), ("TILE_REFS", refs), ("PIECE", piece)):
        monkeypatch.setattr(retrieval_index, name, v)
    rng = np.random.default_rng(3)
    x, y = rng.integers(-2, 3, (30, 4)).astype(float), rng.integers(-2, 3, (200, 4)).astype(float)  # exact products, many ties
    y[::9] = y[0]
    order, s = rng.permutation(200), x @ y.T
    near = rng.random((30, 200)) < 0.1
    for mask, k in ((None, 6), (near, 6), (None, 300)):
        i, j, sim = retrieval_index.largest(x, y, order, k, None if mask is None else lambda a, b: near[a, b])
        for q in range(30):
            at = np.arange(200) if mask is None else np.flatnonzero(near[q])
            want = at[np.lexsort((-order[at], -s[q][at]))[:k]]
            assert j[i == q].tolist() == want.tolist() and sim[i == q].tolist() == s[q][want].tolist()
    y[5], x[2] = np.nan, np.inf
    i, j, _ = retrieval_index.largest(x, y, order, 200)
    assert np.bincount(i, minlength=30).tolist() == [200] * 30 and all(j[i == q][-1] == 5 for q in range(30) if q != 2)


def test_a_search_is_made_once(spark, sf, monkeypatch):
    """Rows that several branches of a plan use come from a table, also where references fill many shards."""
    monkeypatch.setattr(retrieval, "REFERENCE_SHARD", 100)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 30)
    tops = views.top_candidates(spark, sf, 6)
    assert "CoGroup" not in tops._jdf.queryExecution().toString() and tops.count() == 600
    refs = views.frames(spark, sf).where("role = 'reference'").select(F.col("frame_count").alias("r"), "v", F.col("frame_count").alias("ord"))
    indexed = retrieval_index.search(refs.limit(5).select(F.col("r").alias("q"), "v"), refs, 3).tops
    assert "CoGroup" not in indexed._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["retrieval_cross_topk", "retrieval_stride", "retrieval_time_gap"])
def test_blocks_and_shards_find_what_the_sql_finds(spark, duck, sf, monkeypatch, name):
    monkeypatch.setattr(retrieval, "REFERENCE_SHARD", 60)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 30)
    same_as_sql(spark, duck, sf, name)


@pytest.mark.parametrize("name", ["gate_decisions", "gate_sweep_best", "gate_policy_summary", "reference_by_path"])
def test_the_best_candidate_alone_is_searched(spark, duck, sf, monkeypatch, name):
    """What uses the first candidate of each frame does not find six of them."""
    asked, known = [], views.top_references
    monkeypatch.setattr(views, "top_references", lambda q, r, k, gap=None: asked.append(k) or known(q, r, k, gap))
    same_as_sql(spark, duck, sf, name)
    assert asked == [1]


def test_policies_that_accept_a_row_are_found_without_trying_all(spark):
    grid = gating.Grid(ranks=(1, 3), inliers=(0, 50, 100), ratios=(0.0, 0.2), similarities=(0.9, 0.95))
    rows = [(1, 60, 0.2, 0.95), (3, 100, 0.1, 0.9), (4, 500, 1.0, 1.0), (1, 0, 0.0, 0.89), (2, None, 0.5, 0.99), (None, 60, 0.5, 0.99), (1, 200, float("nan"), 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, rank int, lg_inlier_count long, lg_inlier_ratio double, sim double")
    got = grid.accepting(df)
    want = [(k, n) for k, (r, i, t, s) in enumerate(rows) for n, (a, b, c, d) in enumerate(itertools.product(*grid.parts)) if r is not None and i is not None and r <= a and i >= b and (t >= c or t != t) and s >= d]
    assert sorted((r.id, r.grid_ord) for r in got.collect()) == want and got.columns == [*df.columns, "grid_ord"]
    summaries = gating.policy_summaries(df.selectExpr("'a' dataset_id", "id frame_count", "double(id) start_seconds", "*", "1.0 error_m"), grid)
    plan = summaries._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and summaries.agg(F.sum("accepted_fixes")).first()[0] == len(want)


# --- streams


def test_a_stream_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = spark.range(40).selectExpr("id % 2 dataset_id", f"{queries_stream.EPOCH_US} + id us", "id frame_count", "double(id) raw_lat", "double(id) raw_lon")
    rows = rows.mapInPandas(count, rows.schema)
    out = queries_stream._out_of_order(spark, rows, F.lit(0.0), lambda s: ordered.localise_unordered(s, 1.0, queries_stream.GAP_S))
    assert out.where("not late").count() == 40 and seen.value == 40


# --- views from above


def test_equal_cameras_are_viewed_once_and_as_one_row(spark, monkeypatch):
    cameras = [(40.0, 50.0, 30.0), (15.5, 21.0, 297.0), (80.0, 79.0, 0.0), (None, 50.0, 1.0)]
    rows = [(f"d{k % 3}", k, *cameras[k % 4]) for k in range(40)]
    frames = spark.createDataFrame(rows, "dataset_id string, frame_count long, altitude double, angle double, heading double")
    keys, held, known = ["dataset_id", "frame_count"], {}, raster.grid_rows

    def grid_rows(*args, **more):
        held["made"] = known(*args, **more)
        return held["made"]

    monkeypatch.setattr(raster, "grid_rows", grid_rows)
    got = {(r.dataset_id, r.frame_count): r for r in raster.camera_coverage(frames, keys, size=64).collect()}
    assert held["made"].count() == 3 and len(got) == 30
    for r in raster.view_coverage(known(frames, keys, size=64, arrays=False), keys).collect():
        mine = got[r.dataset_id, r.frame_count]
        assert (mine.n_ahead, mine.n_inside) == (r.n_ahead, r.n_inside) and mine.mean_x == pytest.approx(r.mean_x) and mine.mean_y == pytest.approx(r.mean_y)


# --- near-duplicates


def test_components_leave_no_shuffle_files(spark):
    """What the rounds shuffled is let go, so that disk does not grow with the number of rounds."""
    here = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: set(glob.glob(f"{here}/**/shuffle_*.data", recursive=True))
    before = files()
    found = connected_components(spark.range(300).selectExpr("id a", "id + 1 b").repartition(16, "a"))
    for _ in range(40):
        if len(files() - before) <= 16:
            break
        time.sleep(0.5)
    assert len(files() - before) <= 16
    assert found.count() == 301 and found.where("label <> 0").isEmpty()
