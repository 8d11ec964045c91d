import numpy as np
from pyspark.sql import functions as F

from waymark.llm.group_split import assign_splits, best_seed, components, key_groups, rendezvous, split_shares, torn_groups

WANTED = {"train": 0.6, "database": 0.2, "query": 0.2}


def least_nodes(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    pairs = [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 300, (220, 2))] + [(f"z{i:02}", f"z{i + 1:02}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    edges = spark.createDataFrame([*pairs, *pairs[:5], (None, "x"), ("y", None), ("s", "s")], "u string, v string")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == least_nodes([*pairs, ("s", "s")])


def test_records_and_keys_are_one_graph(spark):
    rows = [("a", "p", "train"), ("a", "q", "query"), ("b", "q", "train"), ("c", "r", None), ("d", None, "train"), (None, "r", "train"), (None, None, "query"), ("a", "p", "train")]
    df = spark.createDataFrame(rows, "seq string, author string, split string").withColumns({"n": F.lit(5), "component": F.lit("x"), "record": F.lit("y")})
    got = {(r.seq, r.author, r.split): (r.n, r.component) for r in key_groups(df, ["seq", "author"], "split").collect()}
    assert got == {
        ("a", "p", "train"): (2, "0:a"), ("a", "q", "query"): (1, "0:a"), ("b", "q", "train"): (1, "0:a"), ("c", "r", None): (1, "0:c"),
        ("d", None, "train"): (1, "0:d"), (None, "r", "train"): (1, "0:c"), (None, None, "query"): (1, None),
    }
    assert {r.seq for r in torn_groups(df, "seq").collect()} == {"a"}
    assert torn_groups(df.where("false"), "seq").count() == 0


def test_no_component_is_torn_and_shares_are_met(spark):
    rng = np.random.default_rng(3)
    heavy = [(f"heavy{i}", None) for i in range(12) for _ in range(20 * i + 140)]
    rows = heavy + [(f"s{a}", f"c{b}" if b < 40 else None) for a, b in zip(rng.integers(0, 900, 7000), rng.integers(0, 4000, 7000))]
    df = spark.createDataFrame(rows, "seq string, creator string")
    out = assign_splits(df, ["seq", "creator"], WANTED)
    for key in ("seq", "creator"):
        assert out.where(f"{key} is not null").groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    shares = {r.split: (r.share, r.wanted, r.n) for r in split_shares(out, WANTED).collect()}
    assert set(shares) == set(WANTED) and sum(v[2] for v in shares.values()) == len(rows)
    assert all(abs(got - wanted) < 0.03 for got, wanted, _ in shares.values())


def test_added_records_move_only_merged_components(spark):
    rng = np.random.default_rng(5)
    old = [(f"s{a:04}", f"c{b}" if b < 60 else None) for a, b in zip(rng.integers(0, 1500, 6000), rng.integers(0, 9000, 6000))]
    new = [(f"s{a:04}", None) for a in rng.integers(0, 2500, 4000)] + [("s0001", "c-new"), ("s0002", "c-new")]
    schema = "seq string, creator string"
    seed = best_seed(key_groups(spark.createDataFrame(old, schema), ["seq", "creator"]), WANTED)
    a = {r.seq: (r.component, r.split) for r in assign_splits(spark.createDataFrame(old, schema), ["seq", "creator"], WANTED, seed).collect()}
    b = {r.seq: (r.component, r.split) for r in assign_splits(spark.createDataFrame(old + new, schema), ["seq", "creator"], WANTED, seed).collect()}
    merged = {a["s0001"][0], a["s0002"][0]}
    assert set(a) <= set(b) and all(b[s] == a[s] for s in a if a[s][0] not in merged)


def test_an_added_split_moves_components_to_itself_only(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("c"))
    out = df.select(rendezvous(F.col("c"), {"a": 0.6, "b": 0.4}).alias("x"), rendezvous(F.col("c"), {"a": 0.6, "b": 0.4, "c": 0.25}).alias("y"))
    assert out.where("x <> y and y <> 'c'").count() == 0
    assert abs(out.where("x = 'a'").count() / 5000 - 0.6) < 0.03


def test_empty_and_bad_proportions(spark):
    import pytest

    empty = spark.createDataFrame([], "seq string")
    assert assign_splits(empty, ["seq"], WANTED).count() == 0
    assert {r.n for r in split_shares(assign_splits(empty, ["seq"], WANTED), WANTED).collect()} == {0}
    with pytest.raises(ValueError):
        assign_splits(empty, ["seq"], {"a": -1.0, "b": 2.0})
