import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tidewheel.llm import ngram_join, shingles
from tidewheel.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, num, den):
    """doc_id -> (class, component) by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1:]:
            if a and b and den * len(a & b) >= num * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return {i: root(i) for i in up}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=40)
    base = [rng.choices(vocabulary, k=rng.randint(1, 120)) for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += passage
        out.append((i * 7 % 1000, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return out


def test_shingle_sets_equal_brute_force(monkeypatch):
    monkeypatch.setattr(shingles, "SLICE", 50)
    rng = random.Random(4)
    atoms = ["a", "B", "c", "Dd", "éÉ", "\t", "\n", "", "x\x0by"]
    rows = [None, "", " ", "a", "a b", "long " * 200] + [" ".join(rng.choices(atoms, k=rng.randint(0, 60))) for _ in range(200)]
    for width in (1, 3, 5):
        got = {}
        for first, bounds, values in shingles.shingle_sets(pa.array(rows, pa.string()).slice(1), width):
            got |= {first + i: values[bounds[i]:bounds[i + 1]] for i in range(len(bounds) - 1)}
        want = [shingle_set(r, width) for r in rows[1:]]
        assert [len(got[i]) for i in range(len(want))] == [len(s) for s in want]
        for i in range(0, len(want), 3):
            for j in range(i):
                assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_suffix_bound_is_never_too_low():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(80), rng.randint(0, 60))), dtype=np.uint64) for _ in range(2))
        assert ngram_join.suffix_bound(a, b) >= len(np.intersect1d(a, b))


@pytest.mark.parametrize(("seed", "width", "num", "den"), [(1, 3, 90, 100), (2, 5, 8, 10), (3, 1, 1, 2)])
def test_components_equal_brute_force(spark, seed, width, num, den):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in ngram_join.link(docs, width, num, den).collect()}
    want = brute(rows, width, num, den)
    assert {i: r.component_id for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].n_shingles == len(shingle_set(t, width))


def test_links_that_only_other_pairs_show(spark):
    # A chain: neighbours link, others don't, and the smallest id is at one end.
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([f"v{k}" for k in range(2 * i)] + base[2 * i:])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link(docs, 1, 9, 10).collect()}
    assert got == brute(rows, 1, 9, 10) and set(got.values()) == {0}


def test_special_rows(spark):
    rows = [(3, None), (4, ""), (5, " \t"), (6, "one two"), (7, "ONE two"), (None, "one two"), (8, "a b c d"), (8, "a b c d"), (9, "A b\nc d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(docs, 3, 9, 10).collect()]
    assert sorted(got, key=str) == sorted([(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (None, 1, None), (8, 2, 8), (8, 2, 8), (9, 2, 8)], key=str)
    assert ngram_join.link(docs.limit(0), 3, 9, 10).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
