import numpy as np

from waymark.llm import vector_neighbours as vn


def test_a_crowd_of_one_direction_keeps_the_smallest_ids(spark):
    rng = np.random.default_rng(0)
    one, others = rng.normal(size=64).astype(np.float32), rng.normal(size=(300, 64)).astype(np.float32)
    # Powers of two scale exactly, so all 200 have one direction and different vectors.
    crowd = [(i, (one * np.float32(2.0 ** (i % 200 - 100))).tolist()) for i in range(200)]
    vectors = spark.createDataFrame(crowd + [(1000 + i, v.tolist()) for i, v in enumerate(others)], "image_id long, vec array<float>")
    out = {r.image_id: r.indices for r in vn.nearest(vectors, 5).collect()}
    for i in range(200):
        assert out[i] == [j for j in range(6) if j != i][:5]
