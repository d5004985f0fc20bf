import math
import random
from collections import Counter, defaultdict

import pytest
from tidewheel.llm import perplexity as P


def model(texts, order):
    """probability(gram) of an interpolated modified Kneser-Ney model, from its definition."""
    levels = {order: Counter()}
    for t in texts:
        padded = "\n" * (order - 1) + t
        levels[order].update(padded[i:i + order] for i in range(len(t)))
    for o in range(order - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])
    discounts = {}
    for o, counts in levels.items():
        n = Counter(min(c, 5) for c in counts.values())
        d = [0.5, 1.0, 1.5]
        if all(n[i] for i in (1, 2, 3)):
            y = n[1] / (n[1] + 2 * n[2])
            raw = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
            d = raw if all(0 < x < i for i, x in enumerate(raw, 1)) else d
        discounts[o] = [0.0, *d]
    contexts = {o: defaultdict(list) for o in levels}
    for o, counts in levels.items():
        for g, c in counts.items():
            contexts[o][g[:-1]].append(c)

    def probability(gram):
        o = len(gram)
        lower = probability(gram[1:]) if o > 1 else 1 / (len(levels[1]) + 1)
        seen = contexts[o].get(gram[:-1])
        if not seen:
            return lower
        c, d = levels[o][gram], discounts[o]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in seen) * lower) / sum(seen)

    return probability, levels[1]


def text(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize(("order", "slots"), [(2, 2), (3, 21)])
def test_probabilities_equal_the_definition_and_add_to_one(spark, monkeypatch, order, slots):
    monkeypatch.setattr(P, "SLOT_BITS", slots)
    monkeypatch.setattr(P, "CHARS", 150)
    rng = random.Random(order)
    trained = {"x": [text(rng, "aab b", 400) for _ in range(3)], "y": [text(rng, "cdée", 300), "c"]}
    asked = {"x": [text(rng, "abz\0", 200)], "y": ["cdzé😀"], "none": ["abc"]}
    frame = lambda by: spark.createDataFrame([(k, t) for k, ts in by.items() for t in ts], "lang string, text string")
    top = P.grams(frame(trained), order, True)
    wanted = P.grams(frame(asked), order, False).cache()
    got = {(r.lang, r.gram): r.bits for r in wanted.join(P.probabilities(top, wanted, order), "key").collect()}
    known = {k: model(ts, order) for k, ts in trained.items()}
    for r in wanted.collect():
        if r.lang == "none":
            assert (r.lang, r.gram) not in got
        else:
            assert got[r.lang, r.gram] == pytest.approx(-math.log2(known[r.lang][0](r.gram.replace("\U0010ffff", "\0"))), rel=1e-9)
    probability, letters = known["x"]
    for context in ("a" * (order - 1), "z" * (order - 1)):
        assert sum(probability(context + w) for w in [*letters, "unknown"[:1]]) == pytest.approx(1.0)


def test_classify_scores_whole_texts_by_language(spark, monkeypatch):
    monkeypatch.setattr(P, "CHARS", 64)
    monkeypatch.setattr(P, "SHARD", 40)  # several passes
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(120):
        lang, letters = (("x", "abc "), ("y", "def "))[i % 2]
        rows.append((i, text(rng, letters, rng.randint(1, 150)), lang, "t"))
        labels.append((i, 1, 0))
    rows += [(200, "QZQZ@@##" * 20, "x", "t"), (201, None, "x", "t"), (202, "", "y", "t"), (203, "any", "z", "t"), (204, "any", None, "t"),
             (None, "abc abc", "x", "t"), (1, "def fed", "y", "t"), (205, "bad bad", "x", "t"), (206, "abc", "x", "t")]
    labels += [(205, 1, 1), (206, 1, 0), (206, 0, 0), (None, 1, 0), (200, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    judged = P.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), order=3, quantile=0.9)
    assert judged.columns == ["doc_id", "text", "lang", "perplexity", "threshold", "kept"]
    got = judged.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 1)}
    assert not by[200].kept and by[200].perplexity > by[200].threshold
    assert [by[i].kept for i in (201, 202, 203, 204)] == [False, False, True, True]
    assert by[201].perplexity is None and by[203].perplexity is None and by[204].threshold is None
    from pyspark.sql import functions as F
    ids = spark.range(130).select("id", (F.pmod(F.xxhash64("id"), F.lit(P.FOLDS)) == 0).alias("h"))
    held = {r.id for r in ids.collect() if r.h}
    for lang in "xy":
        trained = [t for i, t, l, _ in rows if i is not None and i < 120 and l == lang and i not in held]
        probability, _ = model(trained, 3)
        bits = {}
        for r in got:
            if r.lang == lang and r.text:
                padded = "\n\n" + r.text
                exact = -sum(math.log2(probability(padded[i:i + 3])) for i in range(len(r.text))) / len(r.text)
                assert math.log2(r.perplexity) == pytest.approx(exact, abs=1.1 / P.GRID)
                bits[r.doc_id, r.text] = math.ceil(round(exact * P.GRID, 6))
        tested = sorted(b for (i, _), b in bits.items() if i in held)
        limit = tested[math.ceil(0.9 * len(tested)) - 1]
        assert all(r.kept == (bits[r.doc_id, r.text] <= limit) for r in got if r.lang == lang and r.text)
    assert P.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
