import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm.cross_split import overlap_join, overlap_report, split_overlaps

KIND = "image_id long, creator_id long, captured_at long, compass_angle double, split string"


def brute(rows):
    def heading(h):
        return None if h is None or h != h or h < 0 else h % 360

    out = set()
    for a in rows:
        for b in rows:
            if a[4] != "train" or b[4] not in ("query", "database") or None in (a[1], b[1], a[2], b[2]) or 0 in (a[2], b[2]):
                continue
            p, q = heading(a[3]), heading(b[3])
            turn = 0 if None in (p, q) else min(abs(p - q), 360 - abs(p - q))
            if a[1] == b[1] and abs(a[2] - b[2]) <= 1000 and turn <= 30:
                out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(600):
        creator = None if rng.random() < 0.05 else int(rng.integers(1, 4))
        at = [None, 0, int(rng.integers(-3000, 60_000)), int(rng.integers(0, 12)) * 1000][rng.choice(4, p=[0.05, 0.05, 0.5, 0.4])]
        angle = [None, -1.0, float("nan"), float(rng.uniform(0, 720)), 30.0 * int(rng.integers(0, 25))][rng.choice(5, p=[0.1, 0.1, 0.05, 0.4, 0.35])]
        rows.append((i, creator, at, angle, [None, "train", "query", "database", "other"][rng.choice(5, p=[0.05, 0.45, 0.25, 0.2, 0.05])]))
    df = spark.createDataFrame(rows, KIND).withColumns({"tokens": F.lit("x"), "token": F.lit(1), "heading": F.lit("y")})
    pairs = split_overlaps(df).collect()
    assert {(r.train_id, r.eval_id) for r in pairs} == brute(rows) and len(pairs) == len(brute(rows))
    report = overlap_report(df).collect()
    assert sum(r.n_pairs for r in report) == len(pairs)


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert split_overlaps(none).count() == 0 and overlap_report(none).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_sets_of_any_size(spark, threshold):
    rng = np.random.default_rng(9)

    def sets(n, start):
        return [(start + i, None if i == 0 else [int(x) for x in rng.zipf(1.6, rng.integers(0, 12)) % 40]) for i in range(n)]

    a, b = sets(60, 0), sets(80, 1000)
    kind = "id long, tokens array<long>"
    got = {(r.id_e, r.id_t) for r in overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), threshold).collect()}
    want = {(i, j) for i, x in a for j, y in b if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= threshold - 1e-12}
    assert got == want and want
    with pytest.raises(ValueError):
        overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 0)
