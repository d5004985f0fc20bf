import random
import zlib
from array import array
from collections import Counter

import pytest
from tidewheel.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(3)
    atoms = [*"abcDEF'st 12\n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　​́̈éßÉÀÿ×ΣςİﬁK中文!?-_.,;*$#😀ŉſ",
             "<|endoftext|>", "<|STARTOFTEXT|>", "'ll", "Å", "각", "hello", "World"]
    known = packing.WordIds(PATH)
    for _ in range(20000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 25)))
        assert b"".join(known.parts(text)) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def test_full_memory_and_slices_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 7)
    monkeypatch.setattr(packing, "SLICE", 11)
    text = " ".join(f"Word{i % 13}, of $%& thé-{i}" for i in range(300))
    got = b"".join(packing.WordIds(PATH).parts(text))
    assert got == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def expand(counts, plan):
    """(bin -> [(offset, length)]) of every piece."""
    bins = {}
    for length, n in counts.items():
        rows = sorted(r for r in plan if r[0] == length)
        for rank in range(n):
            _, first, start, per, offset = next(r for r in reversed(rows) if r[1] <= rank)
            bins.setdefault(start + (rank - first) // per, []).append((offset + (rank - first) % per * length, length))
    return bins


def test_best_fit_is_that_of_one_piece_at_a_time():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([5, 10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        left = []
        for length in sorted(lengths, reverse=True):
            fits = [r for r in left if r >= length]
            if fits:
                left[left.index(min(fits))] -= length
            else:
                left.append(capacity - length)
        counts = Counter(lengths)
        bins = expand(counts, packing.best_fit(counts, capacity))
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sorted(capacity - sum(n for _, n in held) for held in bins.values()) == sorted(left)


def test_pack_places_every_piece_once(spark, tokenizer):
    texts = [None, "", "a", "a", "x " * 25, "one two three four five six seven", "é" * 40, *["same text here"] * 30]
    rows = [(None if i == 2 else i, t, "t", 1) for i, t in enumerate(texts)] + [(3, "a", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, offset int")
    got = packing.pack(docs, PATH, capacity=10).toPandas()
    want = []
    for doc, text, _, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(-1 if doc is None else doc, at // 10, at, len(ids[at:at + 10]), zlib.crc32(array("I", ids[at:at + 10]).tobytes()))
                 for at in range(0, len(ids), 10)]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int).values.tolist())) == sorted(want)
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert held["offset"].tolist() == [0, *held["length"].cumsum().tolist()[:-1]] and held["length"].sum() <= 10
    assert packing.pack(docs.limit(0), PATH).count() == 0
