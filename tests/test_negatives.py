import numpy as np
import pytest

from waymark.operators import dataset

DEG = 180 / (np.pi * 6_371_000)


def test_negatives_are_hard_three_times_in_four_and_easy_otherwise(spark):
    # Pairs 60 m apart every 5 km, and 50 lone images without a ring.
    rows = [(2 * i + j, 40 + i * 5000 * DEG + j * 60 * DEG, 8.0) for i in range(500) for j in (0, 1)] + [(2000 + i, 40 + i * 5000 * DEG, 20.0) for i in range(50)]
    fit = spark.createDataFrame(rows, "image_id long, lat double, lon double")
    drawn = sorted(tuple(r) for r in dataset.hard_negatives(fit, 2, seed=4).collect())
    assert [r[0] for r in drawn] == sorted([r[0] for r in rows] * 2)
    assert all(a != b and d > 25 for a, b, d in drawn)
    paired = [d for a, _, d in drawn if a < 2000]
    assert 0.70 < np.mean([d < 100 for d in paired]) < 0.80
    assert len({b for a, b, d in drawn if d > 100}) > 300
    assert all(d == pytest.approx(60, abs=0.01) for d in paired if d < 100)
    assert drawn == sorted(tuple(r) for r in dataset.hard_negatives(fit, 2, seed=4).collect())
    always = dataset.hard_negatives(fit, 1, hard_share=1.0).where("anchor_id < 2000").collect()
    assert len(always) == 1000 and all(r.d_m < 100 for r in always)


def test_an_anchor_without_any_negative_is_an_error(spark):
    fit = spark.createDataFrame([(1, 52.0, 8.0), (2, 52.0 + 5 * DEG, 8.0)], "image_id long, lat double, lon double")
    with pytest.raises(ValueError):
        dataset.hard_negatives(fit)


def test_the_ring_helps_out_when_every_throw_is_blocked(spark):
    fit = spark.createDataFrame([(1, 52.0, 8.0), (2, 52.0 + 60 * DEG, 8.0)], "image_id long, lat double, lon double")
    out = dataset.hard_negatives(fit, 3, hard_share=0.0, tries=0).collect()
    assert sorted((r.anchor_id, r.negative_id) for r in out) == [(1, 2)] * 3 + [(2, 1)] * 3
