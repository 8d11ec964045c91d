import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import leakage, packing, shared_spans

DOCS = "doc_id long, text string"


def spans(spark, rows, n=120):
    return {tuple(r) for r in shared_spans.shared_spans(spark.createDataFrame(rows, DOCS), min_chars=n).collect()}


def brute_spans(rows, n=120):
    owners = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            owners.setdefault(t[k : k + n], set()).add(i)
    out = set()
    for i, t in rows:
        if i is None or not t:
            continue
        flags = [False] * (len(t) + 1)
        for k in range(len(t) - n + 1):
            if len(owners[t[k : k + n]] - {None}) > 1:
                flags[k : k + n] = [True] * n
        start = None
        for k, f in enumerate(flags):
            if f and start is None:
                start = k
            elif not f and start is not None:
                out.add((i, start, k))
                start = None
    return out


def mashed(rng, alphabet, n_docs=25):
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(60, 400))) for _ in range(8)]
    rows = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(100, 300)], "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("alphabet", ["abcdefghij ", "ab", "äß𝒳😀é "])
@pytest.mark.parametrize("seed", range(2))
def test_spans_equal_brute_force(spark, alphabet, seed):
    rows = mashed(random.Random(seed), alphabet)
    want = brute_spans(rows)
    assert spans(spark, rows) == want and want


def test_span_edges(spark):
    a = "".join(chr(97 + (i * i) % 26) for i in range(120))
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("xyzwvu") for _ in range(n))
    rows = [(1, a), (2, noise(5) + a + noise(9)), (3, a[:119]), (4, None), (5, ""), (6, "q" * 500), (7, "q" * 130), (None, a), (8, noise(200) * 2), (9, " " * 119)]
    assert spans(spark, rows) == brute_spans(rows) == {(1, 0, 120), (2, 5, 125), (6, 0, 500), (7, 0, 130)}
    assert spans(spark, []) == set()
    assert spans(spark, [(1, a), (1, a)]) == set()
    with pytest.raises(ValueError):
        shared_spans.window_width(30)


def test_long_text_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    rows = [(1, long), (2, long[100_000:250_000]), (3, long[:130])]
    assert spans(spark, rows) == {(1, 0, 130), (1, 100_000, 250_000), (2, 0, 150_000), (3, 0, 130)}


def test_digests_of_equal_spans_are_equal_wherever_they_lie():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 3000).astype(np.uint32)
    text[1500:1700] = text[200:400]
    spans = shared_spans.Spans(text)
    at = np.arange(0, 2800)
    keys = set()
    for digest in (spans.digests(at, at + 120), spans.residues(at, at + 120)):
        seen = {}
        for i, d in zip(at, digest):
            seen.setdefault(int(d), set()).add(bytes(text[i : i + 120]))
        assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({bytes(text[i : i + 120]) for i in at})
        keys.add(tuple(digest))
    assert len(keys) == 2
    prime, base = (int(x) for x in shared_spans.PRIMES[0])
    sums, powers = shared_spans._prefixes(text[:50], *shared_spans.PRIMES[0])
    h, mixed = 0, shared_spans._mix32(text[:50])
    for i in range(50):
        h = (h * base + int(mixed[i]) + 1) % prime
        assert int(sums[i + 1]) == h and int(powers[i + 1]) == pow(base, i + 1, prime)


def test_shares(spark):
    a = "".join(chr(97 + (i * i) % 26) for i in range(150))
    df = spark.createDataFrame([(1, a), (2, a + "!" * 50), (3, None), (4, "short")], DOCS).withColumns({"digest": F.lit(1), "id": F.lit("x"), "n_chars": F.lit(0)})
    out = {r.doc_id: (r.n_chars, r.shared_chars, r.n_spans, r.shared_share) for r in shared_spans.shared_shares(df).collect()}
    assert out == {1: (150, 150, 1, 1.0), 2: (200, 150, 1, 0.75), 3: (0, 0, 0, 0.0), 4: (5, 0, 0, 0.0)}


def test_every_stretch_holds_a_whole_chunk():
    rng = np.random.default_rng(0)
    width = shared_spans.window_width(120)
    for alphabet in (2, 5, 1000):
        points = rng.integers(97, 97 + alphabet, 4000).astype(np.uint32)
        _, start, end = shared_spans.chunk_spans(points, np.array([0]), np.array([4000]), width)
        for at in range(0, 4000 - 120):
            assert ((start >= at) & (end <= at + 120)).any()


def brute_leaks(docs, items, n=12):
    out = {}
    for i, t in docs:
        d = leakage.words(t)
        for j, u in items:
            w = leakage.words(u)
            best = 0
            for a in range(len(d)):
                for b in range(len(w)):
                    k = 0
                    while a + k < len(d) and b + k < len(w) and d[a + k] == w[b + k]:
                        k += 1
                    best = max(best, k)
            if best and best >= min(n, len(w)):
                out[i, j] = best
    return out


@pytest.mark.parametrize("shard", [1, 50, 10**6])
def test_leaks_equal_brute_force(spark, shard):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(j, text(rng.choice([0, 1, 5, 11, 12, 13, 40]))) for j in range(25)]
    docs = []
    for i in range(40):
        parts = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1]
            a = rng.randint(0, max(0, len(w) - 8))
            parts += w[a : a + rng.choice([8, 12, 40])] + text(rng.randint(0, 3))
        docs.append((i, "  ".join(parts).upper() if i % 2 else ", ".join(parts)))
    items = [(j, " ".join(w)) for j, w in items]
    want = brute_leaks(docs, items)
    d, e = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = leakage.leaked_passages(d, e, shard_words=shard).collect()
    best = {}
    for r in found:
        best[r.doc_id, r.item_id] = max(best.get((r.doc_id, r.item_id), 0), r.n_words)
        dw, iw = leakage.words(dict(docs)[r.doc_id]), leakage.words(dict(items)[r.item_id])
        assert dw[r.doc_word : r.doc_word + r.n_words] == iw[r.item_word : r.item_word + r.n_words]
    assert best == want and want
    assert {tuple(r) for r in leakage.leaked_pairs(d, e).collect()} == set(want)
    clean = {r.doc_id for r in leakage.without_leaks(d, e).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_leak_edges(spark, monkeypatch):
    assert leakage.words("Ｆｕｌｌ Ｗｉｄｔｈ, snake_case x² İstanbul") == ["full", "width", "snake", "case", "x2", "i", "stanbul"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta")], DOCS)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "Alpha, BETA!"), (5, "beta"), (6, "alpha beta gamma"), (4, "alpha beta")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_pairs(docs, items).collect()} == {(4, 4), (4, 5)}
    assert leakage.leaked_pairs(docs, items.where("false")).count() == 0
    assert leakage.leaked_pairs(docs.where("false"), items).count() == 0
    monkeypatch.setattr(leakage, "ITEM_BLOCK_CHARS", 10)
    assert {tuple(r) for r in leakage.leaked_pairs(docs, items).collect()} == {(4, 4), (4, 5)}


def test_long_sequences_are_planned_quickly_and_filled():
    import time

    rng = np.random.default_rng(0)
    for capacity in (2048, 8192, 32_768):
        histogram = np.bincount(np.clip(rng.lognormal(6, 1.2, 500_000).astype(int), 1, capacity), minlength=capacity + 1)
        began = time.perf_counter()
        patterns = packing.plan(histogram, capacity)
        assert time.perf_counter() - began < 10
        tokens = sum(times * sum(n * m for n, m in p.items()) for p, times in patterns)
        assert tokens == (np.arange(capacity + 1) * histogram).sum() and tokens >= 0.995 * capacity * sum(times for _, times in patterns)
    assert len(packing.combinations(np.arange(1, 32_769), 32_768)) < 400_000


@pytest.mark.parametrize("seed, capacity", [(0, 64), (1, 64), (2, 1), (3, 200)])
def test_plan_places_every_text(seed, capacity):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(histogram, np.clip(rng.geometric(0.06, 5000), 1, capacity), 1)
    placed = np.zeros_like(histogram)
    total = 0
    for pattern, times in packing.plan(histogram, capacity):
        assert sum(n * m for n, m in pattern.items()) <= capacity and times > 0
        total += times
        for n, m in pattern.items():
            placed[n] += m * times
    assert (placed == histogram).all()
    used = (histogram * np.arange(capacity + 1)).sum()
    assert total <= -(-used // capacity) * 1.02 + 2
    assert packing.plan(np.zeros(capacity + 1, dtype=np.int64), capacity) == []


def test_least_squares_fits_an_exact_mix():
    columns = packing.combinations(np.arange(1, 21), 20)
    truth = np.zeros(len(columns))
    truth[[3, 8, 15]] = [5, 2, 7]
    target = np.bincount(columns.ravel(), np.repeat(truth, 3) * (columns > 0).ravel(), minlength=21)
    x = packing.nonnegative_least_squares(columns, target, 3000)
    fitted = np.bincount(columns.ravel(), np.repeat(x, 3) * (columns > 0).ravel(), minlength=21)
    assert (x >= 0).all() and fitted == pytest.approx(target, abs=0.05)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ein", "viel", "längeres", "Wort"]) for _ in range(rng.choice([1, 5, 30, 90, 400])))) for i in range(300)] + [(900, None), (901, ""), (902, "\n \t"), (5, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit("x"), "lane": F.lit(0), "piece": F.lit(0)})
    counts = packing.token_counts(df).toPandas()
    out = packing.pack(df, capacity=128).toPandas()
    assert out.n_tokens.sum() == counts.n_tokens.sum()
    assert (out.groupby(out.doc_id.fillna(-1)).n_tokens.sum() == counts.groupby(counts.doc_id.fillna(-1)).n_tokens.sum()).all()
    split = out.groupby(out.doc_id.fillna(-1)).piece.max()
    whole = counts.groupby(counts.doc_id.fillna(-1)).n_tokens.max()
    assert (split[whole <= 128] == 0).all() and (split[whole > 128] > 0).all()
    out = out.sort_values(["sequence", "start"])
    ends = out.start + out.n_tokens
    follows = (out.sequence.shift(-1) != out.sequence) | (ends == out.start.shift(-1))
    assert follows.all() and ends.max() <= 128 and set(out.sequence) == set(range(out.sequence.max() + 1))
    report = packing.fill_report(packing.pack(df, capacity=128), 128).first()
    assert report.n_tokens == counts.n_tokens.sum() and report.n_sequences <= 1.03 * -(-report.n_tokens // 128)
    none = df.where("false")
    assert packing.pack(none).count() == 0 and packing.fill_report(packing.pack(none)).first().fill is None


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "a" * 200_000), (2, "ab " * 50_000)], DOCS)
    out = packing.pack(df, capacity=1000).toPandas()
    assert (out[out.n_tokens < 1000].groupby("doc_id").size() <= 1).all()
