import json
from itertools import permutations

import numpy as np
import pytest

from waymark.functions import vectors
from waymark.operators import analysis, audit, dataset, descriptors, guard, localize, roads, search, stats
from waymark.sources import formats, staging


def vecs(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "image_id long, vec array<double>")


def unit(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block, cell", [(3, (2, 70)), (0, (100, 1000)), (4096, (1, 1))])
def test_exact_topk_equals_a_full_sort(spark, block, cell):
    x, q = unit(300, 16, 0), unit(7, 16, 1)
    got = search.exact_topk(vecs(spark, q, 1000), vecs(spark, x).repartition(5), 10, block, *cell).orderBy("query_id", "rank").collect()
    sims = np.round(q @ x.T, 9)
    for i in range(7):
        order = np.lexsort((np.arange(300), -sims[i]))[:10]
        assert [r.ref_id for r in got if r.query_id == 1000 + i] == order.tolist()
    few = search.exact_topk(vecs(spark, q, 1000), vecs(spark, x[:4]), 10)
    assert few.count() == 28
    assert search.exact_topk(vecs(spark, q).where("false"), vecs(spark, x), 5).count() == 0


def test_exact_topk_copies_no_reference_for_small_cells(spark):
    sc = spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    x, q = unit(2000, 16, 3), unit(300, 16, 4)
    x[1000:1020] = x[0]  # more ties than a list has room for
    references, queries = staging.stage(vecs(spark, x), "references"), staging.stage(vecs(spark, q, 1990), "queries")
    before = shuffled()
    got = search.exact_topk(queries, references, 5, 0, 4, 50).collect()
    # The queries once, then at most a list for each of the partitions; the cells are 75 x 40.
    assert shuffled() - before < 20_000
    sims = np.round(q @ x.T, 9)
    for i in range(300):
        if i < 10:
            sims[i, 1990 + i] = -np.inf
        order = np.lexsort((np.arange(2000), -sims[i]))[:5]
        assert [r.ref_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1990 + i] == order.tolist()


def test_locate_keeps_a_bad_photo_apart(spark):
    x = unit(50, 16, 2)
    images = spark.createDataFrame([(i, 52.0 + i / 1000, 8.0) for i in range(50)], "image_id long, lat double, lon double")
    q = spark.createDataFrame([(100, x[7].tolist()), (101, None), (102, [1.0])], "image_id long, vec array<double>")
    out = {r.query_id: r for r in search.locate(q, vecs(spark, x), images, 3).collect()}
    assert out[100].lat == pytest.approx(52.007) and out[100].confidence == pytest.approx(1.0) and out[100].error is None
    assert out[101].error and out[102].error and out[101].lat is None
    with pytest.raises(ValueError):
        search.locate(q, vecs(spark, x), images, 1)


@pytest.mark.parametrize("whiten", [False, True])
def test_pca(spark, whiten):
    x = np.random.default_rng(5).normal(size=(500, 12)) * np.arange(1, 13)
    p = descriptors.fit_pca(vecs(spark, x), 4, whiten)
    c = x - x.mean(0)
    values, axes = np.linalg.eigh(np.cov(c.T))
    top = axes[:, np.argsort(-values)[:4]].T
    assert np.abs((p.components * top).sum(1)) == pytest.approx(np.ones(4), abs=1e-8)
    want = c @ p.components.T / (np.sqrt(np.sort(values)[::-1][:4]) if whiten else 1)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r.vec for r in descriptors.apply_projection(vecs(spark, x), p).orderBy("image_id").collect()])
    assert got == pytest.approx(want, abs=1e-8)


def test_clean_and_concat(spark):
    nan = float("nan")
    raw = spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [nan, 1.0]), (None, [1.0, 1.0]), (6, [1.0, None])], "image_id long, vec array<float>")
    rows = descriptors.clean(raw, 2).collect()
    assert [(r.image_id, r.vec) for r in rows] == [(1, [pytest.approx(0.6), pytest.approx(0.8)])]
    a, b = vecs(spark, unit(5, 4, 0)), vecs(spark, unit(5, 3, 1), 1)
    assert descriptors.concat(a, b).count() == 4
    assert descriptors.concat(a, b).select(vectors.norm("vec").alias("n")).first().n == pytest.approx(1.0)
    with pytest.raises(ValueError):
        descriptors.concat(a, b, required=a.where("image_id = 0"))
    report = descriptors.norm_report(raw).first()
    assert (report.n, report.n_null, report.n_not_finite, report.n_zero) == (8, 1, 2, 1)


def test_bootstrap_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i:02}", int(n), int(rng.integers(0, n + 1))) for i, n in enumerate(rng.integers(1, 30, 40))]
    df = spark.createDataFrame(rows, "sequence_id string, n_solvable long, hits_1 long")
    out = stats.bootstrap(df, "sequence_id", (1,), 200, 42).first()
    drawn = np.random.default_rng(42).integers(0, 40, size=(200, 40))
    n, h = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    samples = h[drawn].sum(1) / n[drawn].sum(1)
    assert (out.low, out.high) == pytest.approx(tuple(np.percentile(samples, [2.5, 97.5])), abs=1e-12)
    lanes = [stats.bootstrap(df.repartition(parts), "sequence_id", (1,), 2000, 42, lane_rows=7).first() for parts in (1, 5)]
    assert lanes[0] == lanes[1] and (lanes[0].low, lanes[0].high) == pytest.approx((out.low, out.high), abs=0.02)
    spread, whole = stats.resampled(df, "sequence_id", ["n_solvable"], 3000, 1, lane_rows=7)
    assert spread.mean() == pytest.approx(n.sum(), rel=0.01) and spread.std() == pytest.approx(n.std() * 40**0.5, rel=0.06) and whole[0] == n.sum()
    same = stats.paired_difference(df, df, "sequence_id", (1,), 50).first()
    assert (same.difference, same.low, same.high, same.includes_zero) == (0.0, 0.0, 0.0, True)
    with pytest.raises(ValueError):
        stats.paired_difference(df, df.limit(3), "sequence_id", (1,), 5)


def test_rank_correlations(spark):
    assert stats.spearman_exact([1, 2, 3, 4], [10, 20, 30, 40]) == (1.0, pytest.approx(2 / 24))
    assert stats.spearman_exact([1, 2], [1, 2]) == (None, None)
    for n in (3, 5, 6):
        sums = [sum((i - p) ** 2 for i, p in enumerate(order)) for order in permutations(range(n))]
        assert stats.squared_rank_differences(n).tolist() == np.bincount(sums, minlength=n * (n * n - 1) // 3 + 1).tolist()
    rho, p = stats.spearman_exact([3, 1, 2, 5, 4], [2, 2, 9, 7, 8])
    d = np.array([2, 0, 1, 4, 3]) - np.array([0, 1, 4, 2, 3])
    assert rho == pytest.approx(1 - 6 * (d @ d) / 120) and 0 < p <= 1
    assert stats.spearman_exact(range(9), range(9)) == (1.0, None)
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (5, 9), (None, 1)], "x int, y int")
    import pandas as pd

    want = pd.Series([1, 1, 2, 5]).rank().corr(pd.Series([2, 3, 3, 9]).rank())
    assert stats.rank_correlation(df, "x", "y").first().rho == pytest.approx(want)


def test_splits(tmp_path, spark):
    ids = [f"s{i}" for i in range(20)]
    a = dataset.draw_split(ids, 42, 0.6, 0.2)
    assert a == dataset.draw_split(ids[::-1], 42, 0.6, 0.2)
    assert sorted(sum(a.values(), [])) == sorted(ids) and [len(a[s]) for s in ("train", "database", "query")] == [12, 4, 4]
    for n in range(3, 12):
        assert all(dataset.draw_split(ids[:n], 1, 0.6, 0.2).values())
    with pytest.raises(ValueError):
        dataset.draw_split(ids[:2], 1, 0.6, 0.2)
    assert dataset.read_split_lists(tmp_path) is None
    with pytest.raises(FileNotFoundError, match="query_sequences.txt"):
        dataset.require_split_lists(tmp_path)
    dataset.write_split_lists(tmp_path, a)
    assert dataset.require_split_lists(tmp_path) == a
    lists = spark.createDataFrame([("s1", "train"), ("zz", "query"), ("zy", "query")], "sequence_id string, split string")
    images = spark.createDataFrame([(1, "s1"), (2, "s9")], "image_id long, sequence_id string")
    with pytest.raises(ValueError):
        dataset.adopt_split(images, lists)
    assert {r.image_id: r.split for r in dataset.adopt_split(images, lists, 0.3).collect()} == {1: "train", 2: None}
    fit, val = dataset.fit_and_validation(ids, 0.1, 3)
    assert len(val) == 2 and not set(fit) & set(val)
    one = dataset.validation_halves(spark.createDataFrame([("s",)], "sequence_id string"))
    assert {r.half for r in one.collect()} == {"database", "query"}


def test_rejection_curve_is_exact_with_small_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(np.round(rng.random(), 1)), bool(rng.random() < 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "query_id long, confidence double, correct boolean")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = {r[0]: (i + 1, sum(x[2] for x in order[: i + 1]) / (i + 1)) for i, r in enumerate(order)}
    for rows_per_task in (3, 20, 1000):
        assert {r.query_id: (r.n_kept, r.precision) for r in analysis.rejection_curve(df, rows_per_task).collect()} == want
    odd = spark.createDataFrame([(1, None, True), (2, float("nan"), False), (3, 0.5, None), (4, 0.5, True)], "query_id long, confidence double, correct boolean")
    assert [(r.query_id, r.precision) for r in analysis.rejection_curve(odd).orderBy("n_kept").collect()] == [(3, 0.0), (4, 0.5), (1, 2 / 3), (2, 0.5)]
    assert analysis.rejection_curve(odd.where("false")).count() == 0


def test_pairwise_auc(spark):
    df = spark.createDataFrame([(1, 0.9, True), (1, 0.5, False), (1, 0.9, False), (2, 0.1, True), (3, 0.2, False), (1, None, True)], "query_id long, s double, correct boolean")
    assert tuple(analysis.pairwise_auc(df, "s").first()) == (2, 0.75)


def test_clusters(spark):
    x = np.array([0.0, 10, 500, 505, 900])
    assert localize.cluster_labels(x, np.zeros(5), 25.0).tolist() == [0, 0, 1, 1, -1]
    deg = 1 / 111_195
    rows = [(1, r, s, 52.0 + m * deg, 8.0, 52.0, 8.0) for r, (s, m) in enumerate([(0.8, 5000.0), (0.79, 0.0), (0.79, 10.0)], 1)] + [(2, 1, 0.5, 52.0, 8.0, 52.0, 8.0)]
    found = spark.createDataFrame(rows, "query_id long, rank long, sim double, r_lat double, r_lon double, q_lat double, q_lon double")
    out = {r.query_id: r for r in localize.clustered(found).collect()}
    assert out[1].cluster_error_m == pytest.approx(5.0, abs=0.1) and out[1].snap_error_m == 0.0 and not out[1].gated
    assert out[2].share == 0.0 and out[2].gated_error_m == 0.0
    c = {r.query_id: r.error_m for r in localize.weighted_centroid(found).collect()}
    assert c[1] == pytest.approx((0.8 * 5000 + 7.9) / 2.38, rel=1e-3)


def test_roads(spark):
    edges = spark.createDataFrame([(1, "primary", [(8.0, 52.0), (8.01, 52.0)]), (2, "service", [(8.0, 52.001), (8.01, 52.001)]), (3, "x", [(8.0, 52.0)]), (4, "x", None)], "edge_id long, highway string, pts array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(1, 52.0002, 8.0037), (2, 52.0009, 8.005), (3, 53.0, 8.0), (4, 52.0, 7.9995)], "image_id long, lat double, lon double")
    out = {r.image_id: (r.edge_id, r.d_m) for r in roads.nearest_edge(points, edges, 50.0).collect()}
    assert out[1] == (1, pytest.approx(22.24, abs=0.01)) and out[2][0] == 2 and out[3] == (None, None)
    assert out[4] == (1, pytest.approx(34.23, abs=0.05))
    cover = {r.highway: r.covered_share for r in roads.street_coverage(edges, points).collect()}
    assert 0 < cover["primary"] < 0.1 and 0 < cover["service"] < 0.1


def test_formats(spark, tmp_path):
    names = ["Bad Ort (Süd), Land", "Ærø", "Łódź", "  São Tomé ", "Ａ1 東京x", "Öst--(Ä)", "Þór", "İzmir, TR", None]
    slugs = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").orderBy("i").select(formats.place_slug("name").alias("s"))
    assert [r.s for r in slugs.collect()] == ["bad-ort-sued", "aeroe", "lodz", "sao-tome", "1-x", "oest-ae", "thor", "izmir", None]
    with pytest.raises(Exception, match="nothing is left"):
        spark.createDataFrame([("???",)], "name string").select(formats.place_slug("name")).collect()
    assert formats.variant_base("net_fullref_gv20") == ("net_fullref", "gv20") and formats.variant_base("net") == ("net", None)
    formats.write_record({"a": float("nan"), "b": [1.0, float("inf")]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [1.0, None]}
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert json.loads(formats.as_json(df).first().json) == {"a": 1, "b": None}
    old = spark.createDataFrame([("a", 1, 2), ("b", 3, None)], "k string, x int, y int")
    new = spark.createDataFrame([("a", None, 5), ("c", 7, 8)], "k string, x int, z int")
    assert {tuple(r) for r in formats.merged_records(old, new, "k").collect()} == {("a", 1, 2, 5), ("b", 3, None, None), ("c", 7, None, 8)}
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics/a.jpg").write_bytes(b"\xff\xd8abc\xff\xd9")
    (tmp_path / "pics/b.jpg").write_bytes(b"\xff\xd8abc")
    assert [r.complete for r in formats.complete_images(spark, str(tmp_path / "pics")).orderBy("path").collect()][1] is False
    tiles = spark.createDataFrame([('{"1_2": [{"image_id": 5, "lat": 1.5}], "1_3": []}',), (None,), ("broken",)], "value string")
    assert [(r.tile, r.image_id, r.lat, r.is_pano) for r in formats.tile_points(tiles).collect()] == [("1_2", 5, 1.5, None)]


def test_guard(spark):
    a = {"city": "x", "splits": {"seed": 1}}
    assert guard.fingerprint(a) == guard.fingerprint(dict(reversed(a.items()))) and len(guard.fingerprint(a)) == 10
    with pytest.raises(ValueError, match="splits.seed: 1 -> 2"):
        guard.require_same(a, {"city": "x", "splits": {"seed": 2}}, "ranking")
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert guard.table_digest(df) == guard.table_digest(df.repartition(3).select("s", "i"))
    assert guard.table_digest(df) != guard.table_digest(df.limit(1))
    good = {
        "city": "x", "splits": {"train": 0.6, "database": 0.2, "query": 0.2}, "pairs": {"positive_m": 10, "uncertain_m": 25, "hard_min_m": 25, "hard_max_m": 100},
        "retrieval": {"top_k": 50, "ks": [1, 5], "thresholds_m": [25]},
    }
    guard.validate_config(good)
    bad = good | {"splits": {"train": 0.9, "database": 0.2, "query": 0.2}, "retrieval": {"top_k": 10, "ks": [20], "thresholds_m": [0]}}
    assert len(guard.config_errors(bad)) == 3 and len(guard.config_errors({})) == len(guard.REQUIRED)


def test_audit_helpers(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert audit.missing_fraction(a.where("k is not null"), a.where("k = 1"), "k") == {"expected": 2, "present": 1, "missing": 1, "fraction": 0.5}
    with pytest.raises(ValueError):
        audit.missing_fraction(a.where("k is not null"), a.where("k = 1"), "k", 0.1)
    assert audit.creator_concentration(spark.createDataFrame([], "creator_id long")).count() == 0


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = staging.stage(spark.range(5), "five")
    folder = staging.shared_folder(spark).removeprefix("file://")
    assert df.count() == 5 and f"{folder}/five-" in df.inputFiles()[0]
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named is None or folder == named.rstrip("/").removeprefix("file://")


def test_running_speed_stream(spark, tmp_path):
    from waymark.streaming import arrivals

    rows = [("a", 1000 * i, 52.0 + i * 10 / 111_195, 8.0) for i in range(5)] + [("b", 5, 1.0, 1.0), (None, 1, 1.0, 1.0)]
    spark.createDataFrame(rows, "sequence_id string, captured_at long, lat double, lon double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sequence_id string, captured_at long, lat double, lon double").parquet(str(tmp_path / "in"))
    out = arrivals.run_available(arrivals.running_speed(stream), str(tmp_path / "out"), mode="update")
    assert [(r.sequence_id, round(r.speed_ms, 2)) for r in out.collect()] == [("a", 10.0)]


def test_exact_quantiles(spark, monkeypatch):
    from waymark.operators import quantiles as qs

    monkeypatch.setattr(qs, "FEW", 10)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.lognormal(0, 3, 3000), np.full(1500, 2.5), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    ask = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    assert qs.exact_quantiles(df, "v", ask) == pytest.approx(np.quantile(x, ask).tolist(), rel=1e-12)
    assert qs.exact_quantiles(df.where("false"), "v", ask) == [None] * len(ask)
    assert qs.exact_quantiles(df.limit(1), "v", [0.3]) == [pytest.approx(x[0])]


@pytest.mark.parametrize("k", [1, 3, 7])
def test_top_k_with_ties(k):
    rng = np.random.default_rng(k)
    ids = rng.permutation(60).reshape(3, 20)
    sims = rng.integers(0, 4, (3, 20)).astype(float)
    got, kept = search.top_k(ids, sims, k)
    for i in range(3):
        assert got[i].tolist() == ids[i][np.lexsort((ids[i], -sims[i]))[:k]].tolist()
    assert (np.diff(kept, axis=1) <= 0).all()


def test_embedder_keeps_bad_images_apart(spark):
    from waymark.operators.embedding import HashEmbedder, embed_images

    class Picky(HashEmbedder):
        def embed(self, images):
            if any(b == b"bad" for b in images):
                raise ValueError("unreadable")
            return super().embed(images)

    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"bad")), (3, None), (4, bytearray(b"a"))], "image_id long, content binary")
    out = {r.image_id: r for r in embed_images(df, Picky).collect()}
    assert out[1].vec == out[4].vec and sum(v * v for v in out[1].vec) == pytest.approx(1.0, abs=1e-6)
    assert out[2].vec is None and "unreadable" in out[2].error and out[3].error == "no content"


def test_adapter_training_beats_the_identity_only_if_it_can():
    from waymark.operators.adapter import mini_recall, train_adapter, triplet_loss

    rng = np.random.default_rng(0)
    place = rng.normal(size=(40, 4))
    view = lambda: np.concatenate([place, rng.normal(size=(40, 12))], 1)
    a, p = np.concatenate([view() for _ in range(20)]), np.concatenate([view() for _ in range(20)])
    n = p[rng.permutation(len(p))]
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q, r = norm(view()), norm(view())
    check = lambda ad: mini_recall(ad, q, r, [{i} for i in range(40)])
    best, history = train_adapter(norm(a), norm(p), norm(n), check, epochs=30, batch=32, rate=0.01, margin=0.5, patience=30)
    assert max(history) > history[0] + 0.2 and check(best) == max(history)
    idle, flat = train_adapter(norm(a), norm(p), norm(n), lambda ad: 0.5, epochs=8)
    assert (idle.weights == np.eye(16)).all() and len(flat) == 4
    assert triplet_loss(best, norm(a), norm(p), norm(n), 0.5).mean() < triplet_loss(idle, norm(a), norm(p), norm(n), 0.5).mean()


def test_examples(spark):
    from waymark.operators import examples

    df = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (4, "b", "t")], "i int, c string, s string")
    assert [r["i"] for r in examples.diverse_examples(df, 3, ("c", "s"), "i")] == [1, 4, 2]
    images = spark.createDataFrame([(52.0, 8.0, True), (52.1, 8.1, True), (0.0, 0.0, False)], "lat double, lon double, placed boolean")
    grid = examples.blurred_density(images, 42, 30)
    assert np.expm1(grid).sum() == pytest.approx(2.0) and grid.shape == (30, 42)
    assert examples.blurred_density(images.where("false"), 4, 3).sum() == 0
