"""Secret scans through a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import itertools
import re._parser as regex_parser
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 512
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those whose `group` is shorter than `least` are dropped afterwards."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# A key's body up to its END line: whatever holds no five dashes, so that no other key is crossed. Loops over groups
# are possessive, since Java's regex recurses in all others; none of them would match anything else by giving back.
_TO_END = r"(?:[^-]++|-{1,4}[^-])*+-{5,}END [A-Z ]*PRIVATE KEY-----"
# Without END: header lines, then base64 from a first stretch of 16 on, over line ends (escaped ones too) and indents. A
# header's name has a dash or its colon within 16 characters, so no line is both a header and base64.
_HEADERS = r"(?:[\x20\t]*[\r\n]+[\x20\t]*[A-Za-z][A-Za-z0-9]{0,14}(?:-[A-Za-z0-9-]*)?:[^\r\n]*)++"
_BASE64 = (r"[\x20\t\r\n\\]*[A-Za-z0-9+/=]{16}(?:[A-Za-z0-9+/=\\\r\n]*[A-Za-z0-9+/=\\])?"
           r"(?:[\r\n]+[\x20\t]+[A-Za-z0-9+/=\\\r\n]*[A-Za-z0-9+/=\\])*+")
_KEY_LINES = rf"(?:{_HEADERS}[\r\n]{_BASE64}|{_BASE64})?"
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_KEY_LINES})"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^/\s:@]*:[^/\s:@]+@"),
)

_GAP = None


def _sequences(tokens) -> list[tuple]:
    """The alternatives of a parsed pattern, each a sequence of characters that must stand there and gaps."""
    out: list[tuple] = [()]
    for kind, value in tokens:
        name = str(kind)
        if name == "LITERAL":
            parts = [(chr(value),)]
        elif name == "SUBPATTERN":
            parts = _sequences(value[-1])
        elif name == "BRANCH":
            parts = [s for branch in value[1] for s in _sequences(branch)]
        elif name == "IN" and len(value) <= 8 and all(str(k) == "LITERAL" for k, _ in value):
            parts = [(chr(c),) for _, c in value]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[:2] == (0, 1):
            parts = [(), *_sequences(value[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            parts = [(*s, _GAP) for s in _sequences(value[2])]
        else:
            parts = [(_GAP,)]
        if len(out) * len(parts) > MOST_ALTERNATIVES:
            parts = [(_GAP,)]
        out = [a + b for a, b in itertools.product(out, parts)]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams such that every match holds all of at least one set; None if some
    match need not hold any trigram."""
    found = set()
    for sequence in _sequences(regex_parser.parse(pattern)):
        runs = [""]
        for c in sequence:
            runs = [*runs, ""] if c is _GAP else [*runs[:-1], runs[-1] + c.lower()]
        found.add(frozenset(run[i:i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in found:
        return None
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def postings(docs: DataFrame, keys: Sequence[str], text: Column, grams: Sequence[str]) -> DataFrame:
    """The inverted index (keys, gram) of the given lower-case trigrams."""
    low = F.lower(text)
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(*keys, F.explode(held).alias("gram"))


def candidates(index: DataFrame, keys: Sequence[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(keys, rules): the rules whose trigram query the intersected postings satisfy. Postings of one text
    are intersected before they are shuffled, and are at most as many as there are trigrams in all queries."""
    held = index.groupBy(*keys).agg(F.collect_set("gram").alias("_grams"))
    every = lambda grams: F.size(F.array_intersect("_grams", F.array(*[F.lit(g) for g in sorted(grams)]))) == len(grams)
    hits = []
    for kind, alternatives in queries.items():
        test = every(alternatives[0])
        for grams in alternatives[1:]:
            test = test | every(grams)
        hits.append(F.when(test, F.lit(kind)))
    return held.select(*keys, F.array_compact(F.array(*hits)).alias("rules")).where(F.size("rules") > 0)


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """Running fold from zero of an array of longs; in chunks, since an array grows by being copied."""
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / CHUNK).cast("int") - 1, F.lit(0)))
    part = lambda c: F.slice(values, c * CHUNK + 1, CHUNK)
    zero = F.lit(0).cast("bigint")
    totals = F.transform(chunks, lambda c: F.aggregate(part(c), zero, fold))
    base = lambda c: F.aggregate(F.slice(totals, F.lit(1), c), zero, fold)
    step = lambda held, x: F.concat(held, F.array(fold(F.element_at(held, -1), x)))
    return F.flatten(F.transform(chunks, lambda c: F.slice(F.aggregate(part(c), F.array(base(c)), step), F.lit(2), F.lit(CHUNK))))


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans (start, rank, end, kind) in code points. What lies between matches gives their places."""
    pattern = F.lit(rule.pattern)
    found, checked = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    ends = running(steps, lambda a, b: a + b)
    rows = F.transform(F.arrays_zip(found.alias("m"), checked.alias("g"), ends.alias("e")), lambda x: F.struct(
        (x["e"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(rule.kind).alias("kind"),
        F.length(x["g"]).alias("n")))
    kept = F.filter(rows, lambda x: x["n"] >= rule.least)
    return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind")])).cast(_SPAN)


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and `spans`: array of (start, rank, end, kind) by start, then by the rules' order.

    Each rule's pattern is turned into a Boolean query of trigrams that its matches must hold. The
    postings of those trigrams are intersected, and only the texts that are left are searched by the rule;
    rules without such trigrams search every text. Places are code points of the whole text, ends
    exclusive. NULL text is empty and has no spans. Rows are matched to their postings by id and text hash,
    so repeated and NULL ids are no matter, and each repeated row gets its spans. A column
    named `spans` is replaced. An empty table gives an empty result.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    # The caller's columns travel in one, so that no name can clash.
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    text, keys = F.col("_text"), ["_id", "_hash"]
    grams = sorted({g for q in queries.values() for a in q for g in a})
    if queries:
        chosen = candidates(postings(keyed, keys, text, grams), keys, queries)
        keyed = keyed.join(chosen, keys, "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(None).cast("array<string>"))
    parts = []
    for rank, rule in enumerate(rules):
        # Rules without a trigram query first ask whether there is any match long enough.
        gate = F.array_contains("rules", rule.kind) if rule.kind in queries else _long_enough(text, rule)
        parts.append(F.when(gate, spans_of(text, rule, rank)).otherwise(F.array().cast(_SPAN)))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() != "spans"]
    return keyed.select(*kept, F.array_sort(F.concat(*parts)).alias("spans"))


def _long_enough(text: Column, rule: Rule) -> Column:
    if rule.group == 0 and rule.pattern.endswith("+"):
        return F.rlike(text, F.lit(f"{rule.pattern[:-1]}{{{rule.least},}}"))
    return F.rlike(text, F.lit(rule.pattern))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover, overlapping ones as one, replaced by `mark`."""
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    opens = F.filter(F.zip_with(F.transform(spans, lambda s: s["start"]), F.concat(F.array(F.lit(-1).cast("bigint")), F.slice(reach, F.lit(1), F.size(spans) - 1)),
                                lambda s, r: F.struct(s.alias("start"), r.alias("upto"))), lambda x: x["start"] > x["upto"])
    froms = F.concat(F.transform(opens, lambda x: F.greatest(x["upto"], F.lit(0))), F.array(F.element_at(reach, -1)))
    tos = F.concat(F.transform(opens, lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    pieces = F.zip_with(froms, tos, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(text)
