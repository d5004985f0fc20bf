"""Quality rules with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import settle

_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose `value` is above the cutoff; cutoffs are tried from a fixed grid."""

    name: str
    value: str
    grid: tuple[float, ...]


# The grids are set before any label is seen, from strict to lax.
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    Rule("repeated_lines", "n_dup_lines / greatest(n_words, 1)", (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
)
# At most this share of a stratum's good documents may be rejected by all rules together, but for a chance of DELTA.
ALPHA = 0.01
DELTA = 0.05


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE, -1), lambda w: w != "")


def measures(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """`keep`, and the whole text's n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; 0 without text.

    n_repeat_words counts the words in any window of three that the text holds at least twice. Windows are
    compared by 64-bit hash: sorting (hash, place) puts equal ones side by side.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    plain = docs.select(
        *keep, words(text).alias("_w"), lines.alias("_lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("bigint").alias("n_symbols"))
    n = F.size("_w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    counted = plain.select(
        *keep, "word_chars", "n_symbols", n.cast("bigint").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= 4, F.array_sort(windows)).otherwise(none).alias("_o"))
    same = F.filter("_o", lambda x, i: (x["h"] == F.get("_o", i - 1)["h"]) | (x["h"] == F.get("_o", i + 1)["h"]))
    placed = counted.withColumn("_s", F.array_sort(F.transform(same, lambda x: x["i"]))).drop("_o")
    # A window adds the words that the next one doesn't cover, three at most; the last adds three.
    steps = F.transform("_s", lambda at, i: F.least(F.coalesce(F.get("_s", i + 1) - at, F.lit(3)), F.lit(3)))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda held, x: held + x)
    return placed.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", total.alias("n_repeat_words"))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _log_factorial(n: Column) -> Column:
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exact to rounding below the mean; 1 from the mean on.

    The terms fall from k downward; those beyond ten deviations are below the rounding of their sum.
    """
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    reach = F.least(k, F.ceil(10 * F.sqrt(n * F.lit(p))) + 50).cast("int")
    step = lambda held, t: F.struct(
        (held["term"] * (k - t + 1) * (1 - p) / ((n - k + t) * p)).alias("term"),
        (held["sum"] + held["term"] * (k - t + 1) * (1 - p) / ((n - k + t) * p)).alias("sum"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))), start, step, lambda held: held["sum"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, first).otherwise(first * tail)


def nested_cutoffs(good: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, and a column of each rule's name): the strictest certified vector of cutoffs, NULL for rules not begun.

    `good` has a row for each held-out document of good quality: stratum and measures. The vectors are fixed before any label is seen and nested: they start without
    rules, and each adds the next rule's next cutoff from lax to strict, the rules taking turns. The good
    documents that a vector rejects by any rule are tested against the whole alpha, vector by vector until one
    fails: only the first vector whose true share is above alpha can be certified wrongly, so the sequence
    costs nothing. The m strata that are tested share delta evenly. They are the largest, as many as could pass if no
    good document were rejected, which their sizes alone tell: (1 - alpha)^n <= delta / m. A stratum that
    passes still needs its share for its next vector, so none is handed on to the others.
    """
    turns = len(rules)
    steps = turns * max(len(r.grid) for r in rules)
    above = [F.size(F.filter(F.array(*[F.lit(float(c)) for c in r.grid]), lambda c: F.expr(r.value) > c)) for r in rules]
    # The first vector that rejects the document; NULL if none does.
    first = F.array_min(F.array(*[F.when(n > 0, (len(r.grid) - n) * turns + i) for i, (r, n) in enumerate(zip(rules, above))]))
    counts = settle(good.select("stratum", first.alias("first")).groupBy("stratum", "first").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("_n"))
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_n"), "stratum")))  # one row a stratum
    can = F.when(F.pow(F.lit(1 - alpha), F.col("_n")) <= delta / F.col("_rank"), F.col("_rank"))
    tested = ranked.withColumn("_m", F.max(can).over(Window.partitionBy()))
    tried = tested.select("stratum", "_n", "_rank", "_m", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    rejected = tried.join(counts, "stratum").groupBy("stratum", "_n", "_rank", "_m", "step").agg(
        F.sum(F.when(F.col("first") <= F.col("step"), F.col("n")).otherwise(0)).cast("bigint").alias("_k"))
    passed = (F.col("_rank") <= F.col("_m")) & (binomial_tail(F.col("_n"), F.col("_k"), alpha) <= delta / F.col("_m"))
    last = rejected.groupBy("stratum").agg(F.max(F.when(passed, F.col("step"))).alias("_last"))
    at = lambda i, r: F.element_at(F.array(*[F.lit(float(c)) for c in r.grid]), F.greatest(
        F.lit(len(r.grid)) - F.floor((F.col("_last") - i) / turns), F.lit(1)).cast("int"))
    return last.select("stratum", *[F.when(F.col("_last") >= i, at(i, r)).alias(r.name) for i, r in enumerate(rules)])


def judge(docs: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = ALPHA, delta: float = DELTA,
          id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, the five measures, base_failed and kept of every row.

    Every labelled document of good quality that the base rules pass is a holdout of its stratum, since
    nothing else is fitted. kept is false if base_failed, else unless a rule's value is above its stratum's cutoff. Strata
    without labels, or with too few to certify a cutoff, have no rules but the base ones; NULL is a stratum. Text that is
    NULL has no words and fails. A document with several labels is good if all say so; NULL labels and ids are passed over.
    Repeated rows are judged alike. An empty table gives an empty result; other columns are ignored.
    """
    measured = settle(measures(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("_text")),
                               ["doc_id", "stratum"], "_text").withColumn("base_failed", F.expr(BASE_FAILED)))
    trusted = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q"))
               .where("_q = 1").select("doc_id"))
    chosen = settle(nested_cutoffs(measured.where(~F.col("base_failed")).join(trusted, "doc_id", "left_semi"), rules, alpha, delta))
    fires = F.lit(False)
    for r in rules:
        fires = fires | F.coalesce(F.expr(r.value) > F.col(r.name), F.lit(False))
    return measured.join(chosen, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~fires).alias("kept"))
