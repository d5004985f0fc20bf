"""Text columns and operators: rule checks, scripts, slugs, leaks, aliases, log measurements."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a draft must not contain, in the order the breaks are listed.
CAPTION_RULES = (
    ("an emoji", "[\U0001f000-\U0001faff⌀-⏿☀-➿⬀-⯿️]"),
    ("a #", "[#＃]"),
    ("an @", "[@＠]"),
    ("an exclamation mark", "[!¡！]"),
    ("a link", r"(?iU)https?://|\bwww\.|\b[\w-]+\.(?:com|net|org|io|fm|me|ly|ee|link|app|co|to|be|tv)\b"),
)
# What reads as a path, and what reads as a file's name.
PATHLIKE = (r"(?:^|[^\w.-])/[^/\s]+/|^/[^/\s]+$|^~/|\\|^[A-Za-z]:[\\/]|[^\s/]+/[^\s/]+/")
FILENAME = (r"(?i)[^\s/\\]+\.(?:wav|aiff?|flac|mp3|m4a|ogg|opus|mp4|m4v|mov|mkv|webm|jpe?g|png|tiff?|heic|json|ya?ml)\b")
# Paths that may be shown.
ALLOWED_PREFIXES = ("/opt/homebrew", "/usr/local", "/usr", "/bin", "/nix", "/opt/pw-browsers")
# Arabic yeh and kaf, the Persian letters they stand for, and the isolates.
ARABIC, PERSIAN = "يك", "یک"
ISOLATE, POP = "⁨", "⁩"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
LATIN_RUN = rf"[0-9]*[{LATIN}](?:[{LATIN}0-9'’&.:/\- ]*[{LATIN}0-9])?(?: ?[?!]+)?"
MESSAGE_LENGTH = 300


def rule_breaks(text: Column) -> Column:
    """What in a text breaks the caption rules, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in CAPTION_RULES]))


def persian(text: Column, names: Sequence[str] = ()) -> Column:
    """Persian letters for Arabic ones, except inside the given names; Latin runs inside isolates."""
    # Of names that begin alike the longest counts, so it stands first.
    either = "|".join(re.escape(name) for _, name in sorted((-len(name), name) for name in set(names) - {""}))
    if not either:
        folded = F.translate(text, ARABIC, PERSIAN)
    else:
        # Names and the text between them, alternately: only the text between is folded.
        between = F.split(text, either)
        inside = F.concat(F.regexp_extract_all(text, F.lit(f"({either})"), 1), F.array(F.lit("")))
        folded = F.array_join(F.zip_with(F.transform(between, lambda p: F.translate(p, ARABIC, PERSIAN)), inside,
                                         lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(folded, f"({LATIN_RUN})", f"{ISOLATE}$1{POP}")


def slug(text: Column, any_script: bool = False) -> Column:
    """A name as a key: lower case, hyphens for everything but letters and digits. Accents fold to
    ASCII, or letters of any script stay."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        if any_script:
            return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii").lower())

    other = r"[^\p{L}\p{N}]+" if any_script else "[^a-z0-9]+"
    return F.regexp_replace(F.regexp_replace(normal(text), other, "-"), "^-+|-+$", "")


def unique_suffixes(df: DataFrame, keys: Sequence[str], base: str, order: str, out: str, salt_size: int = 1 << 14) -> DataFrame:
    """Repeated names as name, name-2, name-3, ... in `order`, skipping names that are taken.

    A name is taken by an earlier row's result; a literal `x-2` therefore competes with the second
    `x`. Only families of names (those that differ by numeric suffixes) with both repeats and such
    literals need their order walked; every other name is numbered in parallel.
    """
    from tidewheel.operators.blocks import number_rows

    keys = list(keys)
    family = F.regexp_replace(F.col(base), r"(-[0-9]+)+$", "")
    placed = df.withColumn("_family", family)
    stats = placed.groupBy(*keys, "_family").agg(
        F.count("*").alias("_rows"), F.max((F.col(base) != F.col("_family")).cast("int")).alias("_literal"))
    joined = placed.join(stats, [*keys, "_family"])
    clean = joined.where((F.col("_literal") == 0) | (F.col("_rows") == 1))
    block = F.floor(F.col(order) / salt_size).cast("bigint")
    numbered = number_rows(clean, [*keys, base], [order], block, "_n")
    simple = numbered.withColumn(out, F.when(F.col("_n") == 1, F.col(base)).otherwise(
        F.concat(F.col(base), F.lit("-"), F.col("_n").cast("string"))))
    columns = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def walk(batches):
        taken: set[str] = set()
        last: dict[str, int] = {}
        for pdf in batches:
            names = []
            for name in pdf[base]:
                pick = name
                while pick in taken:
                    last[name] = last.get(name, 1) + 1
                    pick = f"{name}-{last[name]}"
                taken.add(pick)
                names.append(pick)
            yield pdf[columns].assign(**{out: names})

    from collections.abc import Iterator

    walk.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    mixed = joined.where((F.col("_literal") == 1) & (F.col("_rows") > 1))
    ordered = mixed.repartition(*[F.col(k) for k in [*keys, "_family"]]).sortWithinPartitions(*keys, "_family", order)
    walked = ordered.groupBy(*keys, "_family").applyInPandas(walk, schema)
    return simple.select(*df.columns, out).unionByName(walked)


def _leak_reasons(value: Column, tokens: Sequence[str]) -> Column:
    """Why a string may not be published."""
    path = value.rlike("(?U)" + PATHLIKE) & ~value.isin(*ALLOWED_PREFIXES)
    private = [F.when(F.contains(F.lower(value), F.lit(t.lower())), F.lit(f"holds private token #{k}")) for k, t in enumerate(tokens, 1)]
    return F.array_compact(F.array(F.when(path, "looks like a path").when(value.rlike("(?U)" + FILENAME), "names a file"), *private))


def leaks(documents: DataFrame, keys: Sequence[str], document: str, tokens: Sequence[str] = ()) -> DataFrame:
    """Where JSON documents name a path, a file or a private token: (keys, path, reason).

    Documents are flattened level by level until only leaves are left; strings and object keys are
    tested. Text that is no JSON is one string. Keys are numbered from 1 in sorted order, and one that must
    not be shown is replaced by its number: the offending text is never part of the answer.
    """
    spark, keys = documents.sparkSession, list(keys)
    parsed = F.try_parse_json(document)
    level = documents.where(F.col(document).isNotNull()).select(
        *keys, F.lit("$").alias("path"), F.coalesce(parsed, F.to_variant_object(F.struct(F.col(document).alias("text")))).alias("v"),
        parsed.isNull().alias("plain"))
    level = level.select(*keys, "path", F.when(F.col("plain"), F.variant_get("v", "$.text", "variant")).otherwise(F.col("v")).alias("v"))
    found = []
    while True:
        kind = F.schema_of_variant("v")
        strings = level.where(kind == "STRING").select(*keys, "path", F.explode(_leak_reasons(F.variant_get("v", "$", "string"), tokens)).alias("reason"))
        found.append(strings)
        nested = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if nested.isEmpty():
            break
        inside = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            *keys, "path", "pos", "key", "value", F.when(F.col("key").isNotNull(), _leak_reasons(F.col("key"), tokens)).alias("bad"))
        number = (F.col("pos") + 1).cast("string")
        found.append(inside.select(*keys, F.concat("path", F.lit("{key #"), number, F.lit("}")).alias("path"), F.explode("bad").alias("reason")))
        step = (F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
                .when(F.size("bad") > 0, F.concat(F.lit("{#"), number, F.lit("}"))).otherwise(F.concat(F.lit("."), F.col("key"))))
        level = inside.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    return functools.reduce(DataFrame.unionByName, found)


def scrub(message: Column, tokens: Sequence[str] = ()) -> Column:
    """A message fit to publish: path-like words and file names masked, tokens too, 300 characters."""
    words = F.filter(F.split(message, r"\s+"), lambda w: w != "")
    masked = F.transform(words, lambda w: F.when(w.rlike(PATHLIKE), "<path>").when(w.rlike(FILENAME), "<file>").otherwise(w))
    text = F.array_join(masked, " ")
    for token in tokens:
        text = F.regexp_replace(text, f"(?i){re.escape(token)}", "<private>")
    return F.left(text, F.lit(MESSAGE_LENGTH))


def closest(names: DataFrame, known: DataFrame, name: str, candidate: str, cutoff: float = 0.6, k: int = 2) -> DataFrame:
    """The k closest known ids of each unknown name, by edit distance over the longer length.

    `known` is a vocabulary of fixed size carried as one array in the row, so names are never
    multiplied by it; each distinct name is scored once.
    """
    vocabulary = known.agg(F.array_sort(F.collect_set(candidate)).alias("_known"))
    listed = names.select(F.col(name)).distinct().withColumn("_one", F.lit(1)).join(vocabulary.withColumn("_one", F.lit(1)), "_one")
    low = F.lower(F.trim(F.col(name)))
    scored = F.transform("_known", lambda c: F.struct(
        F.round(-(1.0 - F.levenshtein(low, c) / F.greatest(F.length(low), F.length(c)).cast("double")), 9).alias("s"), c.alias("c")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: -x["s"] >= cutoff)), 1, k)
    return listed.select(name, F.transform(best, lambda x: x["c"]).alias("closest"))


def resolve_alias(df: DataFrame, aliases: DataFrame, name: str, alias: str, target: str) -> DataFrame:
    """Ids for names or aliases in any case; NULL where unknown."""
    keyed = df.withColumn("_k", F.lower(F.trim(F.col(name))))
    return keyed.join(aliases.select(F.col(alias).alias("_k"), target), "_k", "left").drop("_k")


# ---- logs
_NUMBER = r"(NaN|-?(?:inf|Infinity|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?))"


def loudness_of(log: Column) -> tuple[Column, Column]:
    """(integrated LUFS, true peak) after the last "Summary:" of a meter's log; NULL where absent."""
    summary = F.when(log.contains("Summary:"), F.substring_index(log, "Summary:", -1))

    def read(label, unit):
        return F.regexp_extract(summary, rf"(?m)^\s*{label}:\s*{_NUMBER}\s*{unit}", 1).try_cast("double")

    return read("I", "LUFS"), read("Peak", "dBFS")


def last_json(log: Column, key: str) -> Column:
    """The last flat JSON block of a log that holds `key`."""
    blocks = F.filter(F.regexp_extract_all(log, F.lit(r"(\{[^{}]*\})"), 1),
                      lambda b: F.get_json_object(b, f"$.{key}").isNotNull())
    return F.try_element_at(blocks, F.lit(-1))


def done_rate(log: Column) -> Column:
    """Frames a second from a render's closing line."""
    return F.regexp_extract(log, rf"in \d+s \({_NUMBER} fps\)", 1).try_cast("double")


# ---- release text
def release_notes(songs: DataFrame, sections: DataFrame, highlights: DataFrame, looks: DataFrame,
                  keys: Sequence[str]) -> DataFrame:
    """One text per song: heading, caption with mood words, chapters, pinned comment, missing data.

    `songs` has title, artist, duration, bpm; `sections` start and name; `highlights` highlight_t;
    `looks` mood (all keyed). A song's few sections and looks are gathered per song.
    """
    from tidewheel.functions.scalar import time_text

    keys = list(keys)
    listed = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("start", F.concat(F.lit("- "), time_text(F.col("start")), F.lit(" "), F.col("name")).alias("line")))).alias("_s"))
    all_ = songs.join(listed, keys, "left").join(highlights, keys, "left").join(looks, keys, "left")
    who = F.when(F.col("artist").isNotNull(), F.concat(F.lit(" by "), F.col("artist"))).otherwise("")
    mood = F.when(F.length(F.coalesce("mood", F.lit(""))) > 0, F.concat(F.lit(" "), F.col("mood"), F.lit("."))).otherwise("")
    lines = F.array_compact(F.array(
        F.concat(F.lit("# "), F.col("title")),
        F.concat(F.lit("length "), time_text(F.col("duration")), F.lit(", "), F.format_string("%.1f", "bpm"), F.lit(" BPM")),
        F.concat(F.lit("caption: "), F.col("title"), who, F.lit("."), mood, F.lit(" Out now.")),
        F.concat(F.lit("chapters:\n"), F.array_join(F.col("_s.line"), "\n")),
        F.when(F.col("highlight_t").isNotNull(), F.concat(F.lit("pinned comment: the change at "), time_text(F.col("highlight_t")))),
        F.when(F.col("highlight_t").isNull(), F.lit("note: no moment worth pinning was found")),
        F.when(F.col("artist").isNull(), F.lit("note: no artist is set"))))
    return all_.select(*keys, F.array_join(lines, "\n").alias("text"))
