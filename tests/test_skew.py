import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators.skew import frames, heavy_keys, sequence_stats

KIND = "image_id long, sequence_id string, captured_at long, lat double, lon double"


def drives(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else "tied" if i % 3 == 1 else f"s{rng.integers(40)}"
        at = 5_000 if s == "tied" and rng.random() < 0.9 else int(rng.integers(0, 50_000))
        rows.append((i, None if rng.random() < 0.02 else s, None if rng.random() < 0.05 else at, float(rng.normal(50, 0.1)) if rng.random() > 0.1 else None, 8.0))
    return spark.createDataFrame(rows, KIND), rows


def test_heavy_path_equals_plain_order(spark):
    df, rows = drives(spark)
    got = frames(df, share=0.02, rows_per_task=50).toPandas().set_index("image_id").sort_index()
    plain = pd.DataFrame(rows, columns=["image_id", "sequence_id", "t", "lat", "lon"]).dropna(subset=["sequence_id"])
    plain["t"] = plain["t"].where(plain["t"] != 0)
    plain = plain.sort_values(["sequence_id", "t", "image_id"], na_position="last")
    plain["no"] = plain.groupby("sequence_id").cumcount() + 1
    plain["gap"] = plain["t"] - plain.groupby("sequence_id")["t"].shift()
    plain = plain.set_index("image_id").sort_index()
    assert list(got.index) == list(plain.index)
    assert (got["frame_no"] == plain["no"]).all()
    assert (got["gap_ms"].fillna(-1) == plain["gap"].fillna(-1)).all()
    same = frames(df, share=1.0).toPandas().set_index("image_id").sort_index()
    pd.testing.assert_frame_equal(got, same)


def test_rounds_of_cuts_have_no_largest_key(spark, monkeypatch):
    from waymark.operators import skew

    monkeypatch.setattr(skew, "CUTS", 4)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    df, _ = drives(spark, 2)
    want = {(r.image_id, r.frame_no, r.gap_ms) for r in frames(df, share=1.0).collect()}
    assert {(r.image_id, r.frame_no, r.gap_ms) for r in frames(df, share=0.001, rows_per_task=15).collect()} == want
    hot = df.where("sequence_id is not null").withColumn("_key", F.coalesce("captured_at", F.lit(1 << 40)))
    assert skew.cut(hot, 15).groupBy("sequence_id", "_path").count().agg(F.max("count")).first()[0] <= 30


def test_repeats_of_one_image_end(spark):
    df = spark.createDataFrame([(7, "s", 5, 1.0, 1.0)] * 200 + [(i, "s", i, 1.0, 1.0) for i in range(100)], KIND)
    assert frames(df, share=0.5, rows_per_task=10).count() == 300


def test_heavy_keys_are_exact(spark):
    df, rows = drives(spark)
    total = len(rows)
    counts = pd.Series([r[1] for r in rows]).value_counts()
    want = {k: n for k, n in counts.items() if n * 50 >= total}
    assert {r.sequence_id: r.n for r in heavy_keys(df, "sequence_id", 0.02).collect()} == want
    assert heavy_keys(df.where("false"), "sequence_id").count() == 0
    exactly = spark.createDataFrame([("a",)] * 2 + [("b",)] * 98, "k string")
    assert {r.k for r in heavy_keys(exactly, "k", 0.02).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        heavy_keys(df, "sequence_id", 0)


def test_empty_and_lonely(spark):
    empty = spark.createDataFrame([], KIND)
    assert frames(empty).count() == 0 and sequence_stats(empty).count() == 0
    one = spark.createDataFrame([(1, "s", 0, None, None)], KIND)
    row = frames(one).first()
    assert row.frame_no == 1 and row.gap_ms is None and row.speed_ms is None


def test_extra_columns_with_clashing_names(spark):
    df, _ = drives(spark)
    odd = df.withColumn("_t", F.lit("x")).withColumn("_no", F.lit(1)).withColumn("n", F.lit(0))
    assert frames(odd, 0.02, 50).count() == frames(df).count()
