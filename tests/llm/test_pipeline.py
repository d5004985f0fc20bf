import corpus_pipeline
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F
from test_ngram_join import brute
from test_secrets import blank
from test_secrets import brute as brute_secrets
from tidewheel.llm import mixing, queries

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    ok, note, _, _ = compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note


def test_stages_are_the_named_ones():
    assert list(STAGES) == ["quality_classifier", "near_duplicates", "secret_scan", "source_mix", "best_fit_packing"]


def test_every_stage_decides_over_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())
    kept = STAGES["quality_classifier"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unique = STAGES["near_duplicates"](spark, kept, SF).cache()
    heads = brute([(r.doc_id, r.text) for r in kept.collect()], 5, 8, 10)
    assert text(unique) == text(kept.where(F.col("doc_id").isin([i for i, head in heads.items() if i == head])))
    clean = STAGES["secret_scan"](spark, unique, SF).cache()
    want = {i: blank(t, brute_secrets(t)) for i, t, _ in text(unique)}
    assert text(clean) == sorted((i, t, len(t)) for i, t in want.items())
    mixed = STAGES["source_mix"](spark, clean, SF).cache()
    copies = mixing.replicate(clean, queries.SOURCE_WEIGHTS, queries.MIX_SEED)
    assert mixed.columns == docs.columns and text(mixed) == text(copies.select(*docs.columns))
    packed = STAGES["best_fit_packing"](spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_take_rows_of_every_kind(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "src1", 0), (None, "the same words again and again", "en", "src0", 30), (3, "a b c d e f", "xx", "src2", 11),
            (3, "a b c d e f", "xx", "src2", 11), (4, "a b c d e f", "xx", None, 11), (5, "token = abcdef123", "xx", "src3", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    unique = STAGES["near_duplicates"](spark, docs, SF)
    assert sorted(str(r.doc_id) for r in unique.collect()) == ["1", "2", "3", "5", "None"]
    assert {r.doc_id: r.text for r in STAGES["secret_scan"](spark, docs, SF).collect()}[5] == "[SECRET]"
    for stage in STAGES.values():
        stage(spark, docs, SF).count()
        stage(spark, docs.limit(0), SF).count()
