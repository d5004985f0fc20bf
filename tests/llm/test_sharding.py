import random
import zlib

import numpy as np
import pytest
from tidewheel.llm import sharding


def test_difference_balances_and_covers():
    rng = random.Random(1)
    for ways in (1, 2, 5, 24):
        sizes = [rng.randint(1, 10_000) for _ in range(rng.randint(1, 400))]
        found = sharding.difference(sizes, ways)
        assert len(found) == len(sizes) and set(found.tolist()) <= set(range(ways))
        sums = np.bincount(found, weights=sizes, minlength=ways)
        assert sums.max() - sums.min() <= max(sizes)
    assert len(sharding.difference([], 3)) == 0


def test_difference_joins_largest_spreads_oppositely():
    # Two ways: 8 against 7, 6 against 5, then the difference 1 against 1, then 4.
    found = sharding.difference([8, 7, 6, 5, 4], 2)
    assert abs(sum(s if f else -s for s, f in zip([8, 7, 6, 5, 4], found, strict=True))) == 2


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    places = {}
    for r in got:
        places.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    return np.bincount([r.shard for r in got], weights=[r.size for r in got], minlength=shards)


@pytest.mark.parametrize(("last", "spread"), [(8192, 0.001), (40, 0.05)])
def test_shards_of_texts_with_a_hot_group(spark, monkeypatch, last, spread):
    monkeypatch.setattr(sharding, "LAST", last)
    monkeypatch.setattr(sharding, "BUCKET", 64)
    monkeypatch.setattr(sharding, "LIGHT", 16)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 8)
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300), "a") for i in range(700)]
    rows += [(None, None, "n"), (None, "null id", "n"), (5, "repeated", "r"), (5, "repeated", "r"), (900, "é" * 30, "u"), (901, "", "e")]
    rows += [(1000 + i, "hot text " * 3, "h") for i in range(350)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_by_bytes(docs, 4).collect()
    sums = check(rows, got, 4)
    assert sums.max() - sums.min() <= spread * sums.sum()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_bytes(docs, 3).count() == 0
