import numpy as np
from pyspark.sql import functions as F

from waymark.llm.queries import queries
from waymark.llm.vector_neighbours import Model, _unit, best_rows, fit, nearest, neighbour_pairs, scan, usable_vectors

QUERIES = queries()
KIND = "image_id long, vec array<float>"


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(n // 12, 1), dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], KIND)


def brute(ids, x, k):
    u = _unit(x)
    sims = np.round(u @ u.T, 9)
    np.fill_diagonal(sims, -9)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]] for i, s in zip(ids, sims)}


def test_recall_against_brute_force(spark):
    x = clustered(6000, 32, 0)
    ids = np.random.default_rng(1).permutation(100_000)[:6000]
    got = {r.image_id: r.indices for r in nearest(frame(spark, ids, x), 5, dim=32, block_rows=800, probes=12, keep=24).collect()}
    want = brute(ids, x, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({*got[i]} & {*want[i]}) / 5 for i in want]) >= 0.9


def test_recall_on_the_descriptors_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/descriptors.parquet")
    rows = usable_vectors(table, 64).toPandas().sort_values("id")
    ids, x = rows["id"].to_numpy(), np.stack(rows["vec"].to_numpy())
    got = {r.image_id: r.indices for r in nearest(table, 5).collect()}
    want = brute(ids, x, 5)
    assert set(got) == set(want)
    assert np.mean([len({*got[i]} & {*want[i]}) / 5 for i in want]) >= 0.98
    for name in ("p6_found", "p6_lists"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_copies_and_scaled_copies(spark):
    x = clustered(40, 8, 3)
    rows = np.concatenate([x, np.tile(x[:1], (30, 1)), 2 * x[:1]])
    ids = np.concatenate([np.arange(100, 140), np.arange(30), [77]])
    got = {r.image_id: (r.indices, r.similarities) for r in nearest(frame(spark, ids, rows), 5, dim=8).collect()}
    assert {i: v[0] for i, v in got.items()} == brute(ids, rows, 5)
    assert got[29][0] == [0, 1, 2, 3, 4] and got[2][0] == [0, 1, 3, 4, 5] and got[29][1] == [1.0] * 5


def test_dirty_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [0.0, -0.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (9, [1.0, None]), (10, [-1.0, -0.0])]
    df = spark.createDataFrame(rows, KIND).withColumns({"id": F.lit("x"), "h1": F.lit(0), "list": F.lit(1)})
    assert {r.id for r in usable_vectors(df, 2).collect()} == {1, 2, 10}
    out = {r.image_id: (r.indices, r.similarities) for r in nearest(df, 5, dim=2).collect()}
    assert out == {1: ([2, 10], [0.0, -1.0]), 2: ([1, 10], [0.0, 0.0]), 10: ([2, 1], [0.0, -1.0])}
    assert {tuple(r) for r in neighbour_pairs(nearest(df, 1, dim=2)).collect()} == {(1, 2), (2, 10)}
    assert nearest(df.where("image_id = 1"), 5, dim=2).first().indices == []
    assert nearest(df.where("false"), 5, dim=2).count() == 0


def test_all_blocks_lists_and_candidates_are_exact(spark):
    x = clustered(900, 8, 11)
    x[500:520] = x[0]
    ids = np.random.default_rng(4).permutation(5000)[:900]
    out = nearest(frame(spark, ids, x), 5, dim=8, block_rows=100, meeting=1.0, probes=10**9, keep=10**9, more=10**9, list_rows=16)
    assert {r.image_id: r.indices for r in out.collect()} == brute(ids, x, 5)


def test_blocks_overlap_until_neighbours_meet():
    x = _unit(clustered(4000, 16, 8)).astype(np.float32)
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:4]
    met = []
    for meeting in (0.5, 0.9, 0.99):
        model = fit(x, 12, rank=3, meeting=meeting)
        row, block = model.blocks(x)
        in_block = np.zeros((len(x), 12), dtype=bool)
        in_block[row, block] = True
        met.append((in_block[:, None] & in_block[near]).any(axis=2).mean())
        assert met[-1] >= meeting - 0.02
    assert met[0] < met[1] < met[2] and fit(x, 12, meeting=0.99, most_copies=1.5).margin < model.margin


def test_score_aware_codes_keep_inner_products():
    x = _unit(clustered(3000, 32, 5)).astype(np.float32)
    aware = fit(x, 4)
    plain = Model(aware.centroids, aware.axes, aware.books, 1.0, aware.margin)
    centres = x[:60]
    home = (x @ centres.T).argmax(1)

    def along(model):
        codes = model.encode(x, centres, home)
        decoded = model.books[np.arange(len(model.books)), codes].reshape(len(x), -1)
        y = x @ model.axes
        return np.abs(((y - (centres @ model.axes)[home] - decoded) * y).sum(1)).mean()

    assert aware.weight > 1 and along(aware) < along(plain)


def test_axes_of_odd_dimension_are_filled_with_zeros():
    x = _unit(clustered(300, 5, 6)).astype(np.float32)
    model = fit(x, 2, energy=1.0)
    assert model.axes.shape == (5, 8) and model.books.shape == (4, 16, 2)
    assert np.allclose(model.axes @ model.axes.T, np.eye(5), atol=1e-5)


def test_table_scan_ranks_like_the_codes():
    rng = np.random.default_rng(2)
    tables, lists = rng.normal(size=(4, 16, 5)), rng.normal(size=(3, 5))
    codes, list_of = rng.integers(0, 16, (4, 2500)), rng.integers(0, 3, 2500)
    sums, step, zero = scan(tables, lists, codes[0::2] * 16 + codes[1::2], list_of)
    got = best_rows(sums, 40)
    exact = tables[np.arange(4)[:, None], codes].sum(0) + lists[list_of]
    assert np.abs(sums * step[:, None] + zero[:, None] - exact.T).max() < 3 * step.max()
    for row, scores in zip(got, exact.T):
        assert list(row) == sorted(set(row)) and len(row) == 40
        assert set(np.argsort(-scores)[:38]) <= set(row)


def test_equal_codes_keep_the_smaller_rows():
    sums, _, _ = scan(np.ones((2, 16, 3)), np.ones((1, 3)), np.zeros((1, 90), dtype=np.intp), np.zeros(90, dtype=np.intp))
    assert best_rows(sums, 7).tolist() == [list(range(7))] * 3


def test_crowded_blocks_are_split(spark):
    x, ids = clustered(400, 8, 9), np.arange(400)
    got = {r.image_id: r.indices for r in nearest(frame(spark, ids, x), 5, dim=8, split_rows=90).collect()}
    assert got == brute(ids, x, 5)
