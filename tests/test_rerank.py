from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import rerank
from waymark.plans import reranking
from waymark.plans.retrieval import FULL, Scene
from waymark.sources.views import IMAGES_SQL, metres_sql


def lattice(t, k, seed):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 1, (t, k)), 52 + rng.normal(0, 0.0005, (t, k)), 8 + rng.normal(0, 0.0005, (t, k)), np.cumsum(rng.uniform(500, 3000, t))


def metres(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    return 2 * 6_371_000 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))


@pytest.mark.parametrize("t, k, seed", [(1, 3, 0), (3, 3, 1), (4, 3, 2)])
def test_posterior_is_the_sum_over_all_paths(t, k, seed):
    sim, lat, lon, at = lattice(t, k, seed)
    posterior, path = rerank.hmm_paths(sim, lat, lon, at, 30.0, 25.0, 8.0)
    weights = {}
    for p in product(range(k), repeat=t):
        s = 30.0 * sum(sim[i, c] for i, c in enumerate(p))
        for i in range(1, t):
            d = metres(lat[i - 1, p[i - 1]], lon[i - 1, p[i - 1]], lat[i, p[i]], lon[i, p[i]])
            s -= abs(d - 8.0 * (at[i] - at[i - 1]) / 1000) / 25.0
        weights[p] = s
    top = max(weights.values())
    total = sum(np.exp(w - top) for w in weights.values())
    for i in range(t):
        for c in range(k):
            assert posterior[i, c] == pytest.approx(sum(np.exp(w - top) for p, w in weights.items() if p[i] == c) / total, abs=1e-9)
    assert tuple(path) == max(weights, key=weights.get)


def test_smoothing_overrules_an_outlier_and_keeps_every_entry(spark):
    deg = 1 / 111_320
    rows = []
    for i in range(3):
        wrong, right = (1, i + 1.0, 900 + i, 0.9, 52.05), (2, i + 1.0, 800 + i, 0.85, 52.0 + i * 8 * deg)
        first, second = (wrong, right) if i == 1 else (right, wrong)
        for rank, (_, _, ref, sim, lat) in enumerate((first, second), 1):
            rows.append((i, rank, ref, 0.9 if rank == 1 else 0.85, i * 1000, lat, 8.0))
    found = spark.createDataFrame(rows, "query_id long, rank long, ref_id long, sim double, q_at long, r_lat double, r_lon double")
    positions = spark.createDataFrame([(i, "s", i + 1) for i in range(3)], "image_id long, sequence_id string, pos long")
    out = rerank.hmm_smoothing(found, positions).collect()
    assert len(out) == 6
    assert {r.query_id: r.ref_id for r in out if r.rank == 1} == {0: 800, 1: 801, 2: 802}
    alone = rerank.hmm_smoothing(found, positions.where("false")).collect()
    assert {r.query_id: r.ref_id for r in alone if r.rank == 1}[1] == 901


@pytest.mark.parametrize("max_frames", [1, 3, 7])
def test_smoothing_in_blocks_equals_the_whole_drive(spark, max_frames):
    t, k, speed = 23, 4, 8.0
    sim, lat, lon, at = lattice(t, k, 5)
    at, width = np.floor(at), np.random.default_rng(6).integers(1, k + 1, t)
    seats = np.sort(np.random.default_rng(7).permutation(40)[:t]) + 1  # the other frames have no list
    for i in range(t):
        sim[i] = -np.sort(-sim[i]) / 10
        sim[i, width[i] :] = -np.inf
    posterior, path = rerank.hmm_paths(sim, lat, lon, at, 30.0, 25.0, speed)
    rows = [(i, c + 1, 100 * i + c, float(sim[i, c]), int(at[i]), float(lat[i, c]), float(lon[i, c])) for i in range(t) for c in range(width[i])]
    found = spark.createDataFrame(rows, "query_id long, rank long, ref_id long, sim double, q_at long, r_lat double, r_lon double")
    positions = spark.createDataFrame([(i, "s", int(seats[i])) for i in range(t)], "image_id long, sequence_id string, pos long")
    out = rerank.hmm_smoothing(found, positions, speed=speed, max_frames=max_frames).collect()
    assert len(out) == len(rows)
    for r in out:
        i, c = divmod(r.ref_id, 100)
        assert r.query_id == i
        assert r.posterior == pytest.approx(posterior[i, c], abs=1e-9)
        assert r.on_path == (path[i] == c)


def test_drive_speed_is_the_median_of_plausible_steps(spark):
    deg = 180 / (np.pi * 6_371_000)
    rows, lat = [], 52.0
    for i, (gap_s, metres_on) in enumerate([(0, 0), (1, 3), (1, 4), (10, 100), (61, 61), (1, 51), (0, 9), (60, 60)]):
        lat += metres_on * deg
        rows.append((i, "a", gap_s * 1000 + (rows[-1][2] if rows else 1_000_000), lat, 8.0))
    rows += [(20, "b", 1_000_000, 52.0, 8.0), (21, None, 1_001_000, 52.0, 8.0), (22, None, 1_002_000, 52.0, 8.0), (23, "c", None, 52.0, 8.0), (24, "c", 1_000_000, 52.0, 8.0)]
    images = spark.createDataFrame(rows, "image_id long, sequence_id string, captured_at long, lat double, lon double")
    assert rerank.drive_speed(images) == pytest.approx((3 + 4) / 2, abs=1e-6)  # of 1, 3, 4 and 10
    with pytest.raises(ValueError):
        rerank.drive_speed(images.where("sequence_id = 'b'"))


def test_the_query_takes_its_speed_from_the_database(spark, small, duck):
    steps = f"""with {IMAGES_SQL}, f as (select *, lag(captured_at) over w as t0, lag(lat) over w as lat0, lag(lon) over w as lon0 from m
  where split = 'database' and placed and captured_at is not null and sequence_id is not null window w as (partition by sequence_id order by captured_at, image_id)),
v as (select captured_at - t0 as dt, {metres_sql("lat0", "lon0", "lat", "lon")} / ((captured_at - t0) / 1000.0) as speed from f where captured_at > t0)
select median(speed) from v where dt <= 60000 and speed <= 50"""
    speed = duck.execute(steps).fetchone()[0]
    hits, positions = Scene(spark, small, FULL).hits, reranking._positions(spark, small)
    key = lambda df: {(r.query_id, r.ref_id): (r.rank, round(r.posterior, 6)) for r in df.collect()}
    out = key(reranking.r2_hmm(spark, small))
    assert out == key(rerank.hmm_smoothing(hits, positions, speed=speed))
    assert out != key(rerank.hmm_smoothing(hits, positions, speed=8.0))


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, ref_id long, sim double")


def test_sequence_window_sums_triangular_weights(spark):
    r = lists(spark, [(1, 1, 10, 0.9), (1, 2, 11, 0.8), (2, 1, 11, 0.9), (3, 1, 12, 0.5), (9, 1, 10, 0.7)])
    pos = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, "s", 5)], "image_id long, sequence_id string, pos long")
    out = {(x.query_id, x.ref_id): (x.rank, round(x.sim, 9)) for x in rerank.sequence_window(r, pos, 1).collect()}
    assert out == {(1, 11): (1, 1.25), (1, 10): (2, 0.9), (2, 11): (1, 1.3), (2, 10): (2, 0.45), (3, 12): (1, 0.5), (9, 10): (1, 0.7)}


def test_verified_first_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(q, r, int(100 + r), 1.0, int(rng.integers(0, 6))) for q in range(40) for r in range(1, 13)]
    found = spark.createDataFrame(rows, "query_id long, rank long, ref_id long, sim double, inl int")
    for least in (0, 1, 3, 9):
        got = {}
        for x in rerank.verified_first(found, F.col("inl"), 8, least).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.ref_id)
        for q in range(40):
            mine = [x for x in rows if x[0] == q]
            head = sorted(mine[:8], key=lambda x: (0, -x[4], x[1]) if x[4] >= least else (1, 0, x[1]))
            assert got[q] == [x[2] for x in head] + [x[2] for x in mine[8:]]


def test_twins_last(spark):
    out = rerank.twins_last(lists(spark, [(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.7)]), F.col("ref_id") == 10).orderBy("rank").collect()
    assert [r.ref_id for r in out] == [11, 12, 10]


def test_fusion(spark):
    c = spark.createDataFrame([(1, 1, 10, 0.9, 0.0, 5.0), (1, 2, 11, 0.8, 1.0, 50.0), (2, 1, 20, 0.5, None, 1.0), (2, 2, 21, 0.5, None, 2.0)], "query_id long, rank long, ref_id long, sim double, det double, d_m double")
    out = {(r.query_id, r.weight): r.ref_id for r in rerank.fused_first(c, (0.0, 2.0)).collect()}
    assert out == {(1, 0.0): 10, (1, 2.0): 11, (2, 0.0): 20, (2, 2.0): 20}


def test_histogram_vectors_have_unit_norm(spark):
    d = spark.createDataFrame([(1, {"a": 4, "b": 1, "x--1": 9}), (2, {"a": 1}), (3, {}), (4, None)], "image_id long, counts map<string,int>")
    rows = rerank.histogram_vectors(d, skip_prefix="x--").toPandas()
    assert set(rows["class"]) == {"a", "b"}
    assert rows.assign(w=rows.weight**2).groupby("image_id").w.sum().tolist() == pytest.approx([1.0, 1.0])
