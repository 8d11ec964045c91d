import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm.stable_sample import SampleState, first_seen, freeze_rates, keyed_uniform, stable_sample, threefry2x32

#: Published known answers of Threefry-2x32 with 20 rounds: counter, key, result.
KNOWN = [
    ((0, 0), (0, 0), (0x6B200159, 0x99BA4EFE)),
    ((0xFFFFFFFF, 0xFFFFFFFF), (0xFFFFFFFF, 0xFFFFFFFF), (0x1CB996FC, 0xBB002BE7)),
    ((0x243F6A88, 0x85A308D3), (0x13198A2E, 0x03707344), (0xC4923A9C, 0x483DF7A0)),
]


@pytest.mark.parametrize("counter, key, result", KNOWN)
def test_known_answers(counter, key, result):
    x0, x1 = threefry2x32(np.array([key[0], 5]), np.array([key[1], 6]), *counter)
    assert (int(x0[0]), int(x1[0])) == result


def test_uniform(spark):
    rows = spark.range(-2000, 2000).select(keyed_uniform(F.col("id")).alias("u"), keyed_uniform(F.col("id"), 1).alias("v")).toPandas()
    assert spark.sql("select cast(null as bigint) as k").select(keyed_uniform(F.col("k")).alias("u")).first().u is None
    assert rows.u.between(0, 1, inclusive="left").all() and rows.u.is_unique
    assert abs(rows.u.mean() - 0.5) < 0.02 and abs(rows.u.corr(rows.v)) < 0.06


def deliveries(spark, upto):
    rows = spark.range(6000).selectExpr("id * 7 as image_id", "timestamp'2020-01-01' + make_dt_interval(id div 20) as ingested_at")
    late = rows.where("image_id % 5 = 0").selectExpr("image_id", "ingested_at + interval 400 days as ingested_at")
    return rows.unionByName(late).unionByName(late).where(F.col("ingested_at") < F.lit(upto).cast("timestamp"))


def ids(df):
    return {r[0] for r in df.select("image_id").collect()}


def test_members_stay_and_partitions_dont_matter(spark):
    old = ids(stable_sample(deliveries(spark, "2020-06-15"), "image_id", target=200, base_rate=0.2))
    new = stable_sample(deliveries(spark, "2023-01-01"), "image_id", target=200, base_rate=0.2)
    assert old and old < ids(new)
    again = stable_sample(deliveries(spark, "2023-01-01").repartition(13).orderBy(F.rand()), "image_id", target=200, base_rate=0.2)
    assert ids(again) == ids(new) and again.count() == len(ids(new))


def test_state_freezes_rates(spark, tmp_path):
    state = SampleState(spark, str(tmp_path / "s"), target=200, base_rate=0.2)
    first = ids(state.advance(deliveries(spark, "2020-06-15"), "image_id"))
    changed = SampleState(spark, str(tmp_path / "s"), target=10, base_rate=0.01)
    second = changed.advance(deliveries(spark, "2023-01-01"), "image_id")
    assert first < ids(second)
    rates = {r.epoch: r.rate for r in spark.read.parquet(str(tmp_path / "s" / "rates-2")).collect()}
    assert rates["2020-01"] == 0.2 and rates["2020-08"] <= 0.01


def test_three_deliveries_give_what_one_pass_gives(spark, tmp_path, monkeypatch):
    from waymark.llm import stable_sample as module

    monkeypatch.setattr(module, "COMPACT", 2)
    state = SampleState(spark, str(tmp_path / "s"), target=200, base_rate=0.2)
    members = set()
    for upto in ("2020-05-01", "2020-08-01", "2020-08-01", "2023-01-01"):
        sample = state.advance(deliveries(spark, upto), "image_id")
        assert members <= ids(sample)
        members = ids(sample)
    whole = stable_sample(deliveries(spark, "2023-01-01"), "image_id", target=200, base_rate=0.2)
    assert {tuple(r) for r in sample.collect()} == {tuple(r) for r in whole.collect()}
    left = {p.name for p in (tmp_path / "s").iterdir()}
    assert {"rates-4", "rates-3", "pieces-4", "pieces-3"} <= left and not left & {"rates-2", "pieces-2", "seen-1", "delivery-4"}
    assert SampleState(spark, str(tmp_path / "s"))._generation() == 4


def test_a_generation_that_was_not_finished_does_not_count(spark, tmp_path):
    state = SampleState(spark, str(tmp_path / "s"), target=200, base_rate=0.2)
    first = ids(state.advance(deliveries(spark, "2020-06-15"), "image_id"))
    (tmp_path / "s" / "seen-2").mkdir()
    (tmp_path / "s" / "pieces-2").mkdir()
    assert first < ids(state.advance(deliveries(spark, "2023-01-01"), "image_id"))


def test_rates_fall_as_more_is_seen(spark):
    rates = freeze_rates(first_seen(deliveries(spark, "2023-01-01"), "image_id"), 200, 0.2).orderBy("epoch").collect()
    assert [r.seen_before for r in rates][0] == 0 and all(a.rate >= b.rate for a, b in zip(rates, rates[1:]))


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, "2020-01-01"), (1, None)], "image_id long, t string").select("image_id", F.col("t").cast("timestamp").alias("ingested_at"), F.lit(1).alias("epoch"), F.lit(2).alias("u"))
    assert stable_sample(rows, "image_id", base_rate=1.0).count() == 0
    assert stable_sample(rows.where("false"), "image_id").count() == 0
    assert stable_sample(rows.selectExpr("cast(image_id as string) as k", "timestamp'2020-01-01' as ingested_at"), "k", base_rate=1.0).count() == 1
