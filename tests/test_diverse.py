from waymark.operators import examples


def test_late_creators_are_seen(spark):
    rows = [(i, "a", "s") for i in range(6000)] + [(6000, "b", "s"), (6001, None, "t"), (6002, None, "u")]
    df = spark.createDataFrame(rows, "i int, c string, s string").repartition(5)
    picked = examples.diverse_examples(df, 5, ("c", "s"), "i")
    assert [tuple(r.values()) for r in picked] == [(0, "a", "s"), (6001, None, "t"), (6000, "b", "s"), (6002, None, "u"), (1, "a", "s")]
    assert len(examples.diverse_examples(df.where("i > 5999"), 12, ("c", "s"), "i")) == 3
