import hashlib
import math

import pytest
from pyspark.sql import functions as F
from tidewheel.llm import mixing


def draw(seed, doc, rate):
    parts = max(1, math.ceil(rate / mixing.PART))
    n = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{'null' if doc is None else doc}|{part}".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, math.exp(-rate / parts)
        total = term
        while total <= u and k < mixing.TOP:
            k += 1
            term *= rate / parts / k
            total += term
        n += k
    return n


def test_counts_are_the_inverted_poisson(spark):
    rows = [(i, "x" * (i % 7), "big" if i % 3 else "small", 5) for i in range(600)]
    rows += [(1000, "rare", "rare", 5), (1001, None, None, 5), (None, "null id", "small", 5), (1002, "other", "unlisted", 5), (3, "repeated", "small", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    weights = {"big": 0.2, "small": 0.5, "rare": 0.3, "absent": 1.0}
    got = mixing.replicate(docs, weights, seed=4)
    assert got.columns == ["doc_id", "text", "source", "copy", "copies", "rate", "shuffle_key"]
    held = {}
    for _, t, s, _ in rows:
        held[s] = held.get(s, 0) + len(t or "") + 1
    total = sum(held[s] for s in ("big", "small", "rare"))
    rate = {s: total * weights[s] / held[s] for s in ("big", "small", "rare")}
    found = {}
    for r in got.collect():
        assert r.rate == pytest.approx(rate.get(r.source, 1.0))
        found.setdefault((r.doc_id, r.text, r.source), []).append((r.copy, r.copies))
    for i, t, s, _ in rows:
        want = draw(4, i, rate[s]) if s in rate else 1
        assert sorted(found.get((i, t, s), [])) == [(c, want) for c in range(want)]
    keys = [r.shuffle_key for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.replicate(docs.repartition(5), weights, seed=4).collect()))


def test_shares_meet_their_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"),
                                     F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    n = {r.source: r["count"] for r in mixing.replicate(docs, weights).groupBy("source").count().collect()}
    assert all(abs(n[s] / 20000 - w) < 0.02 for s, w in weights.items())


def test_weights_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.replicate(docs, {"x": 0.0, "y": 1.0}).collect()} <= {2}
    assert mixing.replicate(docs.limit(0), {"x": 1.0}).count() == 0
    assert mixing.replicate(docs, {"z": 1.0}).count() == 2
    for bad in ({}, {"x": -1.0, "y": 2.0}, {"x": 0.0}):
        with pytest.raises(ValueError):
            mixing.replicate(docs, bad)
