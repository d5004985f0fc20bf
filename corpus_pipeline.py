"""From raw documents to packed sequences: a pipeline of the llm operators.

Every stage takes (spark, docs, sf_dir) and decides over all that the one before it kept. All but the last
return the columns of documents. Each result is written to the shared folder and read back, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import mixing, ngram_join, packing, perplexity, secrets
from tidewheel.llm.queries import MIX_SEED, SOURCE_WEIGHTS, tokenizer_path
from tidewheel.session import shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps; those without text go."""
    return perplexity.classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of five-word shingle sets with a similarity of 0.8 or more.

    Of rows that repeat an id the smallest stays. Documents without words, and those without an id, are
    linked with nothing and stay.
    """
    heads = ngram_join.link(docs, 5, 8, 10).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    kept = named.join(heads, "doc_id", "left_semi").select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced by a mark and n_chars counted anew where there was one."""
    found = secrets.scan(docs)
    has = F.size("spans") > 0
    clean = F.when(has, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    counted = {"n_chars": F.when(has, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return found.withColumn("text", clean).withColumns(counted).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's Poisson rate draws, in shuffled order."""
    return mixing.replicate(docs, SOURCE_WEIGHTS, MIX_SEED).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

# Neither the language model nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
