import math
import random

import pytest
from pyspark.sql import functions as F
from tidewheel.llm import topk


def brute(rows, k, scale=1024):
    whole = {}
    held = []
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(scale * x) for x in v]
            held.append((i, w))
            if i % 3 == 0:
                whole[i] = min(whole.get(i, w), w)
    out = []
    for q, v in whole.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 1024])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "RANGE_ROWS", 4 * block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    rng = random.Random(block)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(4)], 0) for i in range(-5, 150)]
    rows += [(200, None, 0), (201, [], 0), (202, [1.0, None, 0.0, 0.0], 0), (203, [float("nan"), 1.0, 0.0, 0.0], 0), (204, [float("inf"), 0.0, 0.0, 0.0], 0),
             (None, [9.0, 9.0, 9.0, 9.0], 0), (210, [1.0, 2.0], 0), (213, [3.0, 4.0], 0), (216, [1e12, -1e12, 1.0, 1.0], 0), (217, [1e5, 0.0, 0.0, 0.0], 0)]
    rows += [rows[3], rows[3], rows[10]]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    small = [r for r in rows if r[0] not in (216,)]
    got = topk.top_k(docs.where("vec_id <> 216 OR vec_id IS NULL"), F.col("vec_id") % 3 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == brute(small, 5)
    assert topk.top_k(docs.limit(0), F.lit(True)).count() == 0


def test_large_numbers_stay_exact():
    import numpy as np

    q = np.array([[2**30, 1]], dtype=np.int64)
    m = np.array([[2**30, 1], [2**30, 2]], dtype=np.int64)
    assert topk._dot(q, m).tolist() == [[2**60 + 1, 2**60 + 2]]


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    q, m = rng.integers(-50, 50, (9, 6)), rng.integers(-50, 50, (30, 6))
    bound = topk._bounds(q, m.max(0, keepdims=True), m.min(0, keepdims=True))
    assert (bound[:, 0] >= (q @ m.T).max(1)).all()
