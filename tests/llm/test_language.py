import numpy as np
from pyspark.sql import functions as F
from tidewheel.llm import language


def test_trigrams_stand_around_letters():
    place, grams = language.trigrams(["Ab 1c", "", "?", "é"])
    spell = lambda g: "".join(chr(int(g) >> s & language._MASK) for s in (42, 21, 0))
    assert [(int(p), spell(g)) for p, g in zip(place, grams, strict=True)] == [(0, " ab"), (0, "ab "), (0, " c "), (3, " é ")]


def test_profile_is_the_bundle_of_bound_vectors(monkeypatch):
    monkeypatch.setattr(language, "CHARS", 7)
    monkeypatch.setattr(language, "GRAMS", 3)
    texts = ["the cat sat on the mat", "", "Ünïcode, wörds"]
    got = language.profiles(texts, np.array([0, 1, 0]), 2)
    want = np.zeros(language.DIMENSIONS)
    for t in (texts[0], texts[2]):
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            padded = f" {w} "
            for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
                want += np.roll(language._symbol(ord(a)), 2).astype(int) * np.roll(language._symbol(ord(b)), 1) * language._symbol(ord(c))
    assert (got[0] == want).all() and not got[1].any()


def test_identify_defines_every_case(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (3, "the dog", None, "x"), (4, "le chien", None, "x"),
            (5, None, "en", "x"), (6, "123 !!", "fr", "x"), (7, "", None, "x"), (None, "the cat", None, "x"), (3, "the dog", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language.identify(docs, F.col("doc_id") < 3, {"doc_id": F.col("doc_id")}).collect()
    assert [r.lang_pred for r in got] == ["en", "fr", "en", "fr", "und", "und", "und", "en", "en"]
    assert all((r.score == 0) == (r.lang_pred == "und") and 0 <= r.score <= 1 + 1e-9 for r in got)
    assert {r.lang_pred for r in language.identify(docs, F.lit(False), {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language.identify(docs.limit(0), F.lit(True), {"doc_id": F.col("doc_id")}).count() == 0


def test_held_out_accuracy(spark):
    from tidewheel.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_hyperdimensional_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.sum(F.when(F.col("lang") == F.col("lang_pred"), 1).otherwise(0)), F.count("*")).first()
    assert right >= 0.99 * n
