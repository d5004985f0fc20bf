"""Blocked windows, prefixes, percentiles and lookups against brute force, with blocks far smaller than the series."""

import bisect
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.operators import blocks as B
from tidewheel.operators import joins as J
from tidewheel.operators import slopes
from tidewheel.operators.aggregates import majority, top_k
from tidewheel.operators.quantiles import exact_percentiles

RNG = np.random.default_rng(7)
VALUES = {k: RNG.normal(size=n) for k, n in (("a", 203), ("b", 41))}


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in VALUES.items() for i, v in enumerate(vs)], "k string, i long, v double").cache()


def column(df, name, keys=("k",), order="i"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r[order]):
        out.setdefault(r["k"], []).append(r[name])
    return out


def test_neighbour_and_narrow_sum(series):
    got = column(B.neighbour(series, ["k"], "i", {"p": ("v", -3), "n": ("v", 2)}, size=8), "p")
    for k, vs in VALUES.items():
        assert got[k] == [None] * 3 + vs[:-3].tolist()
    total = column(B.sliding_sum(series, ["k"], "i", "v", "s", -5, 4, size=16), "s")
    for k, vs in VALUES.items():
        want = [vs[max(0, i - 5): i + 5].sum() for i in range(len(vs))]
        assert np.allclose(total[k], want)


@pytest.mark.parametrize("lo,hi", [(-70, 30), (0, 79), (-100, 0)])
def test_wide_sum(series, lo, hi):
    total = column(B.sliding_sum(series, ["k"], "i", "v", "s", lo, hi, size=16), "s")
    for k, vs in VALUES.items():
        assert np.allclose(total[k], [vs[max(0, i + lo): i + hi + 1].sum() for i in range(len(vs))])


def test_prefix_folds(series):
    marked = series.withColumn("m", F.when(F.col("i") % 7 == 3, F.col("v")))
    out = B.prefix(marked, ["k"], {"s": ("sum", "v"), "x": ("max", "v"), "c": ("count", "m"), "l": ("last", "m"), "n": ("last", "m", "reverse")},
                   index="i", size=8).cache()
    for k, vs in VALUES.items():
        marks = [v if i % 7 == 3 else None for i, v in enumerate(vs)]
        assert np.allclose(column(out, "s")[k], np.cumsum(vs))
        assert np.allclose(column(out, "x")[k], np.maximum.accumulate(vs))
        assert column(out, "c")[k] == np.cumsum([m is not None for m in marks]).tolist()
        last, want = None, []
        for m in marks:
            last = m if m is not None else last
            want.append(last)
        assert column(out, "l")[k] == want
        nxt, back = None, []
        for m in reversed(marks):
            nxt = m if m is not None else nxt
            back.append(nxt)
        assert column(out, "n")[k] == back[::-1]


def test_islands(series):
    runs = B.islands(series.withColumn("q", F.col("v") > 0), ["k"], "i", "q", size=8).collect()
    for k, vs in VALUES.items():
        want, start = {}, None
        for i, v in enumerate(vs):
            start = (i if start is None else start) if v > 0 else None
            if start is not None:
                want[i] = start
        assert {r["i"]: r["island"] for r in runs if r["k"] == k} == want


@pytest.mark.parametrize("kind", ["linear", "nearest"])
def test_percentiles(spark, kind):
    rng = np.random.default_rng(3)
    data = {"wide": rng.exponential(size=3000), "ties": rng.integers(0, 5, size=2500).astype(float), "few": rng.normal(size=9)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.995}, kind=kind).collect()}
    for k, vs in data.items():
        s = np.sort(vs)
        for name, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.995)):
            want = np.quantile(vs, p) if kind == "linear" else s[int(np.floor(p * (len(s) - 1) + 0.5))]
            assert got[k][name] == pytest.approx(want, abs=1e-12)


def test_percentiles_without_keys_and_with_null_keys(spark):
    rows = [(None if i % 3 == 0 else "x", float(i * 7 % 1001)) for i in range(1001)] + [("x", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    whole = exact_percentiles(df, [], "v", {"p": 0.25}).collect()
    assert len(whole) == 1 and whole[0]["p"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    got = {r["k"]: r["p"] for r in exact_percentiles(df, ["k"], "v", {"p": 0.25}).collect()}
    assert got == {k: pytest.approx(np.quantile([v for g, v in rows if g == k and v is not None], 0.25)) for k in (None, "x")}
    assert exact_percentiles(df.limit(0), ["k"], "v", {"p": 0.5}).count() == 0


def test_running_sums_carry_over_null_keys(spark):
    df = spark.createDataFrame([(None, i, 1.0) for i in range(40)], "k string, i long, v double")
    got = {r["i"]: r["s"] for r in B.prefix(df, ["k"], {"s": ("sum", "v")}, index="i", size=8).collect()}
    assert got == {i: i + 1.0 for i in range(40)}


def test_asof_nearest_and_rank_across_buckets(spark):
    rng = random.Random(5)
    events = sorted(round(rng.uniform(0, 500), 3) for _ in range(60))
    probes = [round(rng.uniform(-20, 520), 3) for _ in range(80)] + events[:5]
    left = spark.createDataFrame([("x", i, t) for i, t in enumerate(probes)], "k string, i long, t double")
    right = spark.createDataFrame([("x", t, j) for j, t in enumerate(events)], "k string, e double, j long")
    back = {r["i"]: r["e"] for r in J.asof_join(left, right, ["k"], "t", "e", ["e"], bucket=7.0).collect()}
    ahead = {r["i"]: r["e"] for r in J.asof_join(left, right, ["k"], "t", "e", ["e"], 0.0, 7.0, forward=True, strict=True).collect()}
    near = {r["i"]: r["nearest_t"] for r in J.nearest_join(left, right, ["k"], "t", "e", bucket=7.0).collect()}
    rank = {r["i"]: r["n"] for r in J.rank_at(left, right, ["k"], "t", "e", "n", bucket=7.0).collect()}
    for i, t in enumerate(probes):
        n = bisect.bisect_right(events, t + 1e-6)
        assert rank[i] == n
        assert back[i] == (events[n - 1] if n else None)
        later = [e for e in events if e > t]
        assert ahead[i] == (later[0] if later else None)
        assert near[i] == min(events, key=lambda e: (abs(e - t), e))


def test_keyframes_hold_ease_and_jump(spark):
    points = spark.createDataFrame([("s", 1.0, 0.0, 0), ("s", 3.0, 1.0, 1), ("s", 3.0, 5.0, 2), ("s", 7.0, 6.0, 3)], "k string, t double, v double, o int")
    times = spark.createDataFrame([("s", x) for x in (0.0, 1.0, 2.0, 3.0, 5.0, 9.0)], "k string, x double")
    got = {r["x"]: r["out"] for r in J.keyframe_values(times, points, ["k"], "x", "t", "v", "out", bucket=2.0, order="o").collect()}
    assert got == pytest.approx({0.0: 0.0, 1.0: 0.0, 2.0: 0.5, 3.0: 5.0, 5.0: 5.5, 9.0: 6.0})


def test_median_slope_selects_without_listing_pairs():
    rng = np.random.default_rng(2)
    for n in (1500, 1501):
        x = rng.integers(0, 400, size=n).astype(float)
        y = np.round(0.3 * x + rng.normal(size=n), 2)
        i, j = np.triu_indices(n, 1)
        dx = x[j] - x[i]
        keep = dx != 0
        assert slopes.median_slope(x, y) == pytest.approx(np.median((y[j] - y[i])[keep] / dx[keep]), abs=1e-6)


def test_top_k_is_whole(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", i % 50, i) for i in range(400)], "k string, s long, i long")
    got = {(r["k"], r["i"]) for r in top_k(df, ["k"], [F.desc("s"), F.asc("i")], 4).collect()}
    rows = [("hot" if i % 3 else "cold", i % 50, i) for i in range(400)]
    want = {(k, i) for key in ("hot", "cold") for k, s, i in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:4]}
    assert got == want


def test_box_mean_keeps_equal_samples(spark):
    from tidewheel.operators.series import box_mean

    frames = spark.createDataFrame([("s", i, float(i)) for i in range(50)], "k string, frame long, v double")
    samples = spark.createDataFrame([("s", 2.0), ("s", 2.0), ("s", 3.0)], "k string, t double")
    got = sorted((r["t"], round(r["m"], 6)) for r in box_mean(samples, frames, ["k"], "t", "v", "m", 0.1, 10.0).collect())
    assert got == [(2.0, 20.0), (2.0, 20.0), (3.0, 30.0)]


def test_median_slopes_of_large_groups_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = [("noise", float(a), float(b)) for a, b in zip(rng.integers(0, 400, 700), rng.normal(size=700))]
    points += [("line", float(i), 0.1 * i + 3.0) for i in range(500)]
    points += [("ties", float(a), float(b)) for a, b in zip(rng.integers(0, 6, 600), rng.integers(0, 4, 600))]
    points += [(None, 5.0, float(i)) for i in range(300)] + [("huge", 1e-3 * i, float(1e6 * rng.normal() + 2e9 * i)) for i in range(201)]
    points += [("few", 0.0, 1.0), ("few", 2.0, 2.0), ("one", 1.0, 1.0), ("line", 1.0, None)]
    frame = spark.createDataFrame(points, "g string, x double, y double")
    whole = {r.g: r.slope for r in slopes.theil_sen(frame, ["g"], "x", "y").collect()}
    monkeypatch.setattr(slopes, "ROWS", 64)
    monkeypatch.setattr(slopes, "SAMPLED", 100)
    blocks = {r.g: r.slope for r in slopes.theil_sen(frame, ["g"], "x", "y").collect()}
    for g in {p[0] for p in points}:
        x, y = (np.array([p[k] for p in points if p[0] == g and p[2] is not None]) for k in (1, 2))
        i, j = np.triu_indices(len(x), 1)
        apart = x[i] != x[j]
        want = np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart]) if apart.any() else 0.0
        assert blocks[g] == pytest.approx(want, rel=1e-9, abs=1e-9) and whole[g] == pytest.approx(want, rel=1e-9, abs=1e-9), g


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6), st.integers(1, 4)), min_size=1, max_size=25))
def test_falling_pairs_by_weight(points):
    group, z, w = (np.array([p[k] for p in points]) for k in range(3))
    want = sum(w[i] * w[j] for i in range(len(points)) for j in range(len(points)) if group[i] < group[j] and z[i] >= z[j])
    assert slopes.falling_pairs(group, z.astype(float), w) == want


def test_majority_of_a_large_group(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=900), 2)
    values[:500] = np.round(4 + 0.01 * rng.integers(-2, 3, 500), 2)
    frame = spark.createDataFrame([("a" if i % 9 else None, int(i), float(v)) for i, v in enumerate(values)], "g string, m long, v double")
    got = majority(frame, ["g"], "v", "m", radius=0.0201).collect()
    for g in ("a", None):
        mine = np.array([r.v for r in got if r.g == g])
        near = np.array([(np.abs(mine - v) <= 0.0201).sum() for v in mine])
        best = max(zip(near, mine))
        inside = np.abs(mine - best[1]) <= 0.0201
        assert all(r.agreed == (pytest.approx(np.median(mine[inside])) if 2 * best[0] > len(mine) else None) for r in got if r.g == g)
        assert [r.outlier for r in got if r.g == g] == (~inside if 2 * best[0] > len(mine) else np.ones(len(mine), bool)).tolist()


def test_measures_pass_python_as_arrays_a_few_pieces_at_once(spark):
    """Spectra leave Python as columns and are stored: no task holds a batch of ten thousand pieces as objects, and none is made twice."""
    from tidewheel.operators import samples as A

    rows = spark.range(4000).selectExpr("'a' AS series_id", "id AS i", "sin(id / 3) AS l", "cos(id / 5) AS r")
    blocks = A.sample_blocks(rows, ["series_id"], "i", "l", 256, "r")
    measured = A.measure(blocks, ["series_id"], 800, frames_per_block=32)
    assert measured._settled_path
    assert sorted(r.frame for r in measured.collect()) == list(range(501))
    bands = A.alignment_bands(blocks, ["series_id"], 800, 32)
    plan = bands._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and bands.select("frame").distinct().count() == 501


@pytest.mark.parametrize("kind", ["linear", "nearest"])
def test_percentiles_of_small_and_large_groups_are_the_same(spark, kind):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=700), "b": np.array([3.0]), None: rng.integers(-3, 3, 90).astype(float), "d": np.array([-0.0, 0.0, 2.0])}
    data = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("empty", None)], "k string, v double")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.995, "top": 1.0}
    each = [{r.k: tuple(r)[1:] for r in exact_percentiles(data, ["k"], "v", probs, kind, small=small).collect()} for small in (0, 100, 10_000)]
    assert each[0] == each[1] == each[2] and set(each[0]) == set(groups)
    if kind == "linear":
        assert each[0]["a"] == pytest.approx(np.quantile(groups["a"], list(probs.values())))
