import math

import pytest
from pyspark.sql import functions as F

from waymark.operators import evaluation as ev
from waymark.operators import twins

DAY = 86_400_000
DEG = 1 / 111_320
KIND = "image_id long, lat double, lon double, heading double, compass_angle double, creator_id long, captured_at long, is_pano boolean, sequence_id string, split string, placed boolean"


#: The scene and lists below are the ones whose expected recalls are known.
def images(spark, pano=()):
    rows = []
    for i in range(10):
        h = 180.0 if i in (1, 2) else 0.0
        rows.append((100 + i, 52.0 + i * 100 * DEG, 8.0, h, h, 2 if i == 4 else 1, (600 if i == 0 else 1000) * DAY, False, "d", "database", True))
    for i, north in enumerate((4, 115, 208, 330, 404)):
        rows.append((i, 52.0 + north * DEG, 8.0, 0.0, 0.0, 1, 1000 * DAY, i in pano, "q", "query", True))
    return spark.createDataFrame(rows, KIND)


LISTS = [[0, 9, 8, 7, 6], [5, 1, 9, 8, 7], [2, 9, 8, 7, 6], [3, 9, 8, 7, 6], [9, 8, 7, 4, 6]]


def rankings(spark):
    return spark.createDataFrame([(q, r + 1, 100 + ref, 1.0 - r / 10) for q, refs in enumerate(LISTS) for r, ref in enumerate(refs)], "query_id long, rank long, ref_id long, sim double")


def run(spark, truth=None, keep=None, pano=()):
    every = images(spark, pano)
    q, b = ev.queries_of(every, keep), ev.references_of(every)
    flags = ev.per_query(q, ev.nearby(q, b, 25.0), ev.hits(rankings(spark), q, b), truth, (10.0, 25.0))
    return {(r.threshold_m, r.k): (r.n_queries, r.n_solvable, r.recall) for r in ev.recall(flags, (10.0, 25.0), (1, 5)).collect()}


def test_hand_computed(spark):
    got = run(spark)
    assert got[(10.0, 1)] == (5, 3, pytest.approx(2 / 3)) and got[(10.0, 5)] == (5, 3, 1.0)
    assert got[(25.0, 1)] == (5, 4, 0.5) and got[(25.0, 5)] == (5, 4, 1.0)


def test_heading_and_hard(spark):
    for truth in (ev.facing_hit(90), ev.hard_hit(180)):
        got = run(spark, truth)
        assert got[(25.0, 1)][1:] == (2, 0.5) and got[(25.0, 5)][1:] == (2, 1.0)


def test_own_column_as_ground_truth(spark):
    assert run(spark, F.lit(False))[(25.0, 1)] == (5, 0, None)


def test_without_panoramas(spark):
    got = run(spark, keep=~F.col("is_pano"), pano=(1, 3))
    assert got[(25.0, 1)] == (3, 3, pytest.approx(2 / 3))


def test_random_rankings_are_stable_and_complete(spark):
    every = images(spark)
    q, b = ev.queries_of(every), ev.references_of(every)
    a = sorted(map(tuple, ev.random_rankings(q, b, 7).collect()))
    assert a == sorted(map(tuple, ev.random_rankings(q.repartition(5), b.repartition(3), 7).collect()))
    assert len(a) == 35 and {r[2] for r in a} <= {100 + i for i in range(10)}


def test_dense_positions(spark):
    rows = ev.dense_positions(spark.range(1000), "id", lanes=16).collect()
    assert sorted(r.pos for r in rows) == list(range(1000))


def test_empty(spark):
    none = images(spark).where("false")
    flags = ev.per_query(none, ev.nearby(none, none, 25.0), ev.hits(rankings(spark), none, none), None, (25.0,))
    assert ev.recall(flags, (25.0,), (1,)).first().asDict() == {"threshold_m": 25.0, "k": 1, "n_queries": 0, "n_solvable": 0, "n_hits": 0, "recall": None}


def test_twins(spark):
    kind = "image_id long, creator_id string, captured_at long, lat double, lon double, compass_angle double, is_pano boolean"
    q = spark.createDataFrame([(1, "a", 100_000, 52.0, 8.0, 10.0, False), (2, "b", 0, 52.0, 8.0, -1.0, True), (3, None, 5, 52.0, 8.0, 0.0, False)], kind)
    r = spark.createDataFrame(
        [(11, "a", 160_000, 52.0, 8.0, 355.0, False), (12, "a", 160_001, 52.0, 8.0, 10.0, False), (13, "a", 40_000, 52.0, 8.0, 190.0, False), (14, "b", 59_999, 52.0, 8.0, None, True), (15, None, 5, 52.0, 8.0, 0.0, False), (1, "a", 100_000, 52.0, 8.0, 10.0, False)],
        kind,
    )
    pairs = {(p.query_id, p.ref_id): p.is_copy for p in twins.twin_pairs(q, r).collect()}
    assert pairs == {(1, 11): True, (1, 13): False, (2, 14): True}
    counts = {c.query_id: (c.n_twins, c.has_copy, c.min_dt_ms) for c in twins.twin_counts(q, r).collect()}
    assert counts == {1: (2, True, 60_000), 2: (1, True, 59_999), 3: (0, False, None)}


def test_distances_use_haversine(spark):
    near = ev.nearby(ev.queries_of(images(spark)), ev.references_of(images(spark)), 25.0).where("query_id = 0").first()
    assert near.d_m == pytest.approx(4 * DEG * math.pi / 180 * 6_371_000, rel=1e-9)
