"""The registered query of each operator of this subpackage, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import fixity, language, mixing, more_queries, ngram_join, packing, perplexity, quality_rules, secrets, sharding, topk
from tidewheel.session import settle, table


def op1_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's CRC is not 1 modulo 3."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return language.identify(docs, ~held_out, {"doc_id": F.col("doc_id"), "held_out": held_out})


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of at least 0.9."""
    linked = ngram_join.link(table(spark, sf_dir, "documents"), 3, 90, 100)
    return linked.select("doc_id", "n_shingles", "component_id")


OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i+2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base rules' spans, and the spans of all rules."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES],
                        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def _op5_sql() -> str:
    # RE2 has no possessive loops and needs none: it doesn't recurse.
    quoted = lambda p: "'" + p.replace("*+", "*").replace("++", "+").replace("'", "''") + "'"
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, regexp_split_to_array(t, {quoted(r.pattern)}) AS b FROM d"
        for i, r in enumerate(rules))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT doc_id, kind, rank, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS st,
             length(m[i]) AS n FROM u WHERE length(g[i]) >= least),
j AS (SELECT doc_id, kind, rank, st, kind || ':' || CAST(st AS BIGINT) || ':' || CAST(st + n AS BIGINT) AS span FROM s)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY st, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY st, rank), '') AS spans
FROM d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id"""


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, its language's threshold, and whether it is kept."""
    judged = perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, by language."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op7_sql() -> str:
    """A document is rejected if the first vector that rejects it comes no later than its stratum's last certified one."""
    rules, alpha, delta = quality_rules.RULES, quality_rules.ALPHA, quality_rules.DELTA
    space, turns = "[\\x20\\x09-\\x0D]+", len(rules)
    above = [" + ".join(f"CASE WHEN {r.value} > {c!r} THEN 1 ELSE 0 END" for c in r.grid) for r in rules]
    first = ", ".join(f"CASE WHEN {n} > 0 THEN ({len(r.grid)} - ({n})) * {turns} + {i} END" for i, (r, n) in enumerate(zip(rules, above, strict=True)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range(0, 3) AS x(o) GROUP BY doc_id),
m AS (SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d
      LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (SELECT *, ({quality_rules.BASE_FAILED}) AS base_failed, least({first}) AS first_step FROM m),
g AS (SELECT stratum, first_step FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
z AS (SELECT stratum, n, row_number() OVER (ORDER BY n DESC, stratum) AS place FROM (SELECT stratum, count(*) AS n FROM g GROUP BY stratum)),
y AS (SELECT *, (SELECT max(place) FROM z WHERE pow(1 - {alpha!r}, n) <= {delta!r} / place) AS shares FROM z),
k AS (SELECT y.stratum, n, shares, step, count(*) FILTER (first_step <= step) AS k FROM y JOIN g ON g.stratum = y.stratum, range(0, {turns * max(len(r.grid) for r in rules)}) AS x(step)
      WHERE place <= shares GROUP BY y.stratum, n, shares, step),
c AS (SELECT stratum, max(step) AS last_step FROM k WHERE k < n * {alpha!r} AND
      list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r}))))
      <= {delta!r} / shares GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(first_step <= last_step, false) AS kept
FROM b LEFT JOIN c ON c.stratum = b.stratum"""


def op8_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best matches of every hundredth vector among all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, 10)


OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a damaged replica of the archives of all pages differs from the sound one.

    The damage follows from the ids: a first character overwritten, ten last characters lost, or a whole
    record lost. Either replica has the offsets of its own records, so all that follow a loss have moved.
    """
    sound = fixity.page_records(table(spark, sf_dir, "pages"))
    record, n = F.col("record"), F.length("record")
    damaged = sound.where(F.coalesce(F.pmod("id", F.lit(389)) != 7, F.lit(True))).withColumn(
        "record", F.when(F.pmod("id", F.lit(97)) == 5, F.concat(F.lit("#"), F.substring(record, 2, 2**31 - 1)))
        .when(F.pmod("id", F.lit(211)) == 3, F.left(record, n - 10)).otherwise(record))
    replicas = [fixity.laid_out(fixity.fingerprints(side)) for side in (sound, damaged)]
    return fixity.audit(*replicas).withColumnRenamed("id", "page_id")


OP9_SQL = """
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
o AS (SELECT *, printf('pages-%08d.warc', page_id // 1000) AS archive, CASE WHEN page_id % 389 = 7 THEN NULL WHEN page_id % 97 = 5 THEN '#' || substr(record, 2)
             WHEN page_id % 211 = 3 THEN left(record, length(record) - 10) ELSE record END AS other FROM r),
d AS (SELECT *, coalesce(sum(strlen(record)) OVER w, 0) AS l, CASE WHEN other IS NOT NULL THEN coalesce(sum(strlen(other)) OVER w, 0) END AS r FROM o
      WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT archive, CAST(l AS BIGINT) AS "offset", CAST(r AS BIGINT) AS right_offset, page_id,
       CASE WHEN other IS NULL THEN 'missing' WHEN other = record THEN 'moved' ELSE 'damaged' END AS status,
       CAST(strlen(record) AS BIGINT) AS left_length, CAST(strlen(other) AS BIGINT) AS right_length, sha256(record) AS left_sha256, sha256(other) AS right_sha256
FROM d WHERE other IS NULL OR other <> record OR l <> r"""

# Target shares by bytes: one dominant source is brought down to a tenth, the others share the rest evenly.
SOURCE_WEIGHTS = {"src0": 0.1, **{f"src{i}": 0.9 / 19 for i in range(1, 20)}}
MIX_SEED = 17


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix by SOURCE_WEIGHTS, in the mix's order."""
    mixed = mixing.replicate(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, MIX_SEED)
    return mixed.select("doc_id", "source", "copy", "copies", "shuffle_key")


_WEIGHTS_SQL = ", ".join(f"('{s}', CAST({w!r} AS DOUBLE))" for s, w in SOURCE_WEIGHTS.items())
OP10_SQL = f"""
WITH RECURSIVE w(source, weight) AS (VALUES {_WEIGHTS_SQL}),
held AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS held FROM documents GROUP BY source),
both_ AS (SELECT w.source, weight, held FROM w JOIN held USING (source)),
r AS (SELECT source, (SELECT sum(held) FROM both_) * (weight / (SELECT sum(weight) FROM both_)) / held AS rate FROM both_),
p(source, rate, parts) AS (SELECT source, rate / greatest(1, ceil(rate / 64)), greatest(1, CAST(ceil(rate / 64) AS INTEGER)) FROM r),
c(source, rate, k, term, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM p
  UNION ALL SELECT source, rate, k + 1, term * (rate / (k + 1)), total + term * (rate / (k + 1)) FROM c WHERE k < 255),
d AS (SELECT doc_id, source, part, CAST('0x' || substr(md5('{MIX_SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || part), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents LEFT JOIN p USING (source), LATERAL (SELECT unnest(range(1, coalesce(parts, 1) + 1)) AS part)),
n AS (SELECT d.doc_id, d.source, CAST(CASE WHEN max(p.source) IS NULL THEN 1 ELSE count(c.k) END AS INTEGER) AS copies
      FROM d LEFT JOIN p ON p.source = d.source LEFT JOIN c ON c.source = d.source AND c.total <= d.u GROUP BY d.doc_id, d.source)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, copies,
       CAST('0x' || substr(md5('order{MIX_SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(0, copies)) AS copy)"""


QUERIES = {
    "op1_karmarkar_karp": op1_karmarkar_karp,
    "op2_hyperdimensional_language": op2_hyperdimensional_language,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_trigram_secrets": op5_trigram_secrets,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_risk_controlled_rules": op7_risk_controlled_rules,
    "op8_block_topk": op8_block_topk,
    "op9_merkle_fixity": op9_merkle_fixity,
    "op10_poisson_mixing": op10_poisson_mixing,
    **more_queries.QUERIES,
}

ORACLES = {
    "op4_ngram_jaccard": OP4_SQL,
    "op5_trigram_secrets": _op5_sql(),
    "op7_risk_controlled_rules": _op7_sql(),
    "op8_block_topk": OP8_SQL,
    "op9_merkle_fixity": OP9_SQL,
    "op10_poisson_mixing": OP10_SQL,
    **more_queries.ORACLES,
}
