import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewheel.llm import spelling


def edits(word, alphabet):
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in alphabet)
        yield from (word[:i] + c + word[i:] for c in alphabet)


def brute(rows, least_length=6, least_count=5, factor=5, every=199):
    counts = Counter()
    for doc, text in rows:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    alphabet = sorted(set("".join(kept)))
    near = {w: {x for x in edits(w, alphabet) if x in kept and x != w} for w in kept}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-kept[x], x), default=None)
        form[w] = best if best is not None and kept[best] >= factor * kept[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), kept[form[w]] if form[w] else None) for w, n in kept.items()}


def found(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def corpus():
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdeéßÿ×") for _ in range(rng.choice([6, 7, 8, 12]))) for _ in range(30)]
    pool = []
    for b in bases:
        pool += [b] * 40
        for _ in range(4):
            i = rng.randrange(len(b))
            pool += [rng.choice([b[:i] + b[i + 1:], b[:i] + "x" + b[i:], b[:i] + "z" + b[i + 1:], b[:i] + b[i] + b[i:]])] * rng.choice([1, 5, 7, 60])
    rng.shuffle(pool)
    rows = [(d, " ".join(pool[d::60])) for d in range(60)]
    giant = "q" * 3000
    rows += [(None, "Straße straßE " * 6), (900, None), (901, ""), (902, "12 ___ \n"), (3, rows[3][1]), (3, rows[3][1]),
             (903, " ".join([giant, giant + "q", giant[:-1] + "r"] * 6)), (904, " ".join("abcdef ABCDEF, Études-études" for _ in range(5)))]
    return rows


def test_every_word_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[0] is not None and v[1] != v[0] for v in want.values()) or len(want) > 50
    assert found(spelling.variants(docs)) == want
    assert found(spelling.variants(docs, 7, 2, 2, 3)) == brute(rows, 7, 2, 2, 3)


def test_blocks_of_a_large_group_meet(spark, monkeypatch):
    stems = [f"commonprefix{a}{b}{c}{d}" for a in "abcd" for b in "efgh" for c in "ijk" for d in "lmn"]
    rows = [(i, " ".join(stems)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "BLOCK_POINTS", 200)  # a dozen words a block
    assert spelling.tiles(spelling.frequent(spelling.words(docs), 6, 5)).where("NOT (first AND second)").count() > 100
    assert found(spelling.variants(docs)) == brute(rows)


def test_no_documents(spark):
    assert found(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == {}
    assert found(spelling.variants(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), min_size=2, max_size=12, unique=True))
def test_common_ends_tell_single_edits(drawn):
    lengths, left, right = spelling._matrices(np.array(drawn, dtype=object))
    for half in range(0, 4):
        by_prefix = spelling.near((lengths, left, right), (lengths, left, right), half, True)
        for i, a in enumerate(drawn):
            one = set(edits(a, "abé")) - {a}
            assert [b for j, b in enumerate(drawn) if by_prefix[i, j]] == [b for b in drawn if b in one]
