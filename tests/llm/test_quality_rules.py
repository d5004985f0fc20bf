import math
import random
import re

import pytest
from pyspark.sql import functions as F
from tidewheel.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + o for i, x in enumerate(windows) if windows.count(x) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    rng = random.Random(11)
    atoms = ["a", "b", "c", "Dé", "😀", "#$", "|", "\n", "\n", "\t", "\x0b", "x<y>"]
    rows = [None, "", " ", "\n\n", "a", "a a a", "a a a a", "a b c a b c", "a b a b a b a", "same\nsame\n \nother\nsame"]
    rows += [" ".join(rng.choices(atoms, k=rng.randint(0, 80))) for _ in range(200)] + ["word " * 5000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, n_words int")
    got = {r[0]: tuple(r)[1:] for r in Q.measures(docs, ["doc_id"]).collect()}
    for i, t in enumerate(rows[:-1]):
        assert got[i] == brute(t), t
    assert got[len(rows) - 1] == (5000, 20000, 0, 0, 5000)


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 5, 30, 200, 1000, 40_000) for k in {0, 1, 3, n // 500, n // 250, n // 100} if k <= n]
    for p in (0.0025, 0.1):
        df = spark.createDataFrame(cases, "n long, k long").withColumn("p", Q.binomial_tail(F.col("n"), F.col("k"), p))
        for r in df.collect():
            exact = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log1p(-p))
                              for i in range(r.k + 1))
            assert r.p == (pytest.approx(exact, rel=1e-7) if r.k < r.n * p else 1.0)


RULES = (Q.Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.01, 0.05, 0.2)), Q.Rule("long_words", "word_chars / greatest(n_words, 1)", (3.0, 9.0)))


def test_judge_defines_every_case(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, "en", 0), (2, None, "en", 0), (3, "short", "en", 0), (4, "x y " * 40, None, 0), (None, clean, None, 0), (1, clean, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in Q.judge(docs, labels).collect())
    assert got == sorted([("1", 60, False, True), ("1", 60, False, True), ("2", 0, True, False), ("3", 1, True, False), ("4", 80, True, False), ("None", 60, False, True)])
    assert Q.judge(docs.limit(0), labels).count() == 0 and Q.judge(docs, labels.limit(0)).count() == 6


def goods(spark, n, symbols=lambda i: 2, stratum="x"):
    rows = [(stratum, 100, 400, symbols(i)) for i in range(n)]
    return spark.createDataFrame(rows, "stratum string, n_words int, word_chars int, n_symbols int")


def test_nested_cutoffs_test_the_union_in_sequence(spark):
    # Vectors: symbols 0.2; long_words 9.0; symbols 0.05; long_words 3.0, which rejects all; two with nothing new.
    one = lambda *parts, **kw: {r.stratum: (r.symbols, r.long_words) for r in Q.nested_cutoffs(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), RULES, **kw).collect()}
    assert one(goods(spark, 300), alpha=0.01, delta=0.05) == {"x": (0.05, 9.0)}
    assert one(goods(spark, 298), alpha=0.01, delta=0.05) == {"x": (None, None)}
    # 40 of 4,000 are above every cutoff for symbols: 1 % can't be certified against 1 %, but against 2 %.
    many = goods(spark, 4000, lambda i: 100 if i % 100 == 0 else 2)
    assert one(many, alpha=0.01, delta=0.05) == {"x": (None, None)} and one(many, alpha=0.02, delta=0.05) == {"x": (0.05, 9.0)}
    # Above 0.05 only: the sequence stops after long_words 9.0.
    assert one(goods(spark, 4000, lambda i: 40 if i % 100 == 0 else 2), alpha=0.01, delta=0.05) == {"x": (0.2, 9.0)}
    # Two strata share delta only if both could pass: 368 documents are needed then, 299 alone.
    assert one(goods(spark, 2000), goods(spark, 367, stratum="y"), alpha=0.01, delta=0.05) == {"x": (0.05, 9.0), "y": (None, None)}
    assert one(goods(spark, 2000), goods(spark, 368, stratum="y"), alpha=0.01, delta=0.05) == {"x": (0.05, 9.0), "y": (0.05, 9.0)}


def test_nested_cutoffs_hold_their_guarantee(spark):
    # Six corpora of ten languages whose second vector is just above alpha: at most delta of them may certify it.
    rng = random.Random(5)
    wrong = 0
    for _ in range(6):
        rows = [(f"s{s}", 100, 400, 40 if rng.random() < 0.021 else 2) for s in range(10) for _ in range(600)]
        got = Q.nested_cutoffs(spark.createDataFrame(rows, "stratum string, n_words int, word_chars int, n_symbols int"), RULES[:1], alpha=0.02, delta=0.05).collect()
        assert all(r.symbols is not None for r in got)
        wrong += any(r.symbols < 0.2 for r in got)
    assert wrong <= 1


def test_judge_rejects_in_a_language_of_500_good_documents(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(clean).alias("text"), F.lit("fr").alias("lang"))
    junk = spark.createDataFrame([(1000, clean + "".join(f" ###{i}" for i in range(40)), "fr")], docs.schema)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = {r.doc_id: r.kept for r in Q.judge(docs.unionByName(junk), labels).where("NOT base_failed").collect()}
    assert got == {**{i: True for i in range(500)}, 1000: False}


def plain_cutoffs(rows, rules, alpha, delta):
    """{stratum: cutoffs} of (stratum, n_words, word_chars, n_symbols), vector by vector."""
    value = (lambda r: r[3] / max(r[2], 1), lambda r: r[2] / max(r[1], 1))
    strata = {}
    for r in rows:
        strata.setdefault(r[0], []).append(r)
    order = sorted(strata, key=lambda x: (-len(strata[x]), x))
    share = max([i for i, x in enumerate(order, 1) if (1 - alpha) ** len(strata[x]) <= delta / i], default=0)
    out = {}
    for place, x in enumerate(order, 1):
        held, best = [None] * len(rules), [None] * len(rules)
        for step in range(len(rules) * len(rules[0].grid) if place <= share else 0):
            i, level = step % len(rules), step // len(rules)
            held[i] = rules[i].grid[max(0, len(rules[i].grid) - 1 - level)]
            n, k = len(strata[x]), sum(any(c is not None and value[j](r) > c for j, c in enumerate(held)) for r in strata[x])
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha)) for i in range(k + 1))
            if k < n * alpha and tail <= delta / share:
                best = list(held)
        out[x] = tuple(best)
    return out


def test_nested_cutoffs_equal_a_plain_version(spark):
    rng = random.Random(9)
    rows = []
    for s, n in enumerate((60, 310, 420, 700, 1500, 2500)):
        bad = rng.choice([0.0, 0.002, 0.006])
        rows += [(f"s{s}", 100, rng.choice([200, 400, 950]) if rng.random() < bad else 280, rng.choice([5, 30, 120]) if rng.random() < bad else 1) for _ in range(n)]
    want = plain_cutoffs(rows, RULES, 0.01, 0.05)
    got = {r.stratum: (r.symbols, r.long_words) for r in Q.nested_cutoffs(spark.createDataFrame(rows, "stratum string, n_words int, word_chars int, n_symbols int"), RULES, 0.01, 0.05).collect()}
    assert got == want and len(set(want.values())) > 2


def test_the_sql_twin_decides_rows_too(spark, tmp_path):
    import duckdb
    from tidewheel.llm.queries import ORACLES, op7_risk_controlled_rules

    rng = random.Random(4)
    text = lambda junk: " ".join(f"w{rng.randrange(10**6)}" for _ in range(55)) + " #" * junk
    rows = [(i, text(0 if i % 5 else rng.choice([0, 6, 40])), "en" if i % 2 else "fr") for i in range(1600)] + [(5000, "few", "de"), (5001, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1) for i, t, _ in rows if t and "#" not in t] + [(5000, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in op7_risk_controlled_rules(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(tuple(r) for r in con.execute(ORACLES["op7_risk_controlled_rules"]).fetchall())
    assert sum(not r[6] and not r[7] for r in got) > 100
