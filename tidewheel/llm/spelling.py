"""Spelling variants: frequent words one edit apart, each led to the form that is clearly more frequent.

Dense prefix-suffix tiling. Words are rows of padded code-point matrices, aligned left and right; a tile compares
two blocks of words at once, and two words are one edit apart when their common prefix and suffix together reach
the longer length minus one. An edit leaves the first or the last half of the shorter word as it is, so
only blocks of words that share such a half are paired. Only counts and best forms per word leave a tile, never
its pairs.

Results where the data are odd: NULL and empty texts have no words. A NULL id reads as the empty text in the
hash. A document that stands in several rows is counted in each. An empty table gives no rows. Words
have any length: a block is bounded by its code points. Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.session import discard, settle

#: Letters: A to Z in either case, and U+00C0 to U+00FF. All fit one byte.
RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many of a document loses a letter, by the hash of id and run.
CUT_EVERY = 199
#: Code points of a block of words (about 1,000 words of usual length), and of one step's comparisons.
BLOCK_POINTS, STEP_POINTS = 16_384, 4_000_000


def words(docs: DataFrame, every: int = CUT_EVERY) -> DataFrame:
    """(word) for each run of letters in the texts, A to Z lower-cased, one in `every` short of a letter."""
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("_run"))
    crc = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    place = (F.col("_crc") % F.length("_run")).cast("int")
    short = F.concat(F.substring("_run", F.lit(1), place), F.substring("_run", place + 2, F.length("_run")))
    return runs.withColumn("_crc", crc).select(F.when(F.col("_crc") % every == 0, short).otherwise(F.col("_run")).alias("word"))


def frequent(found: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves() -> Column:
    """The groups that a word is compared in: by first and by last half, as the shorter word and as the longer."""
    n = F.length("word")
    groups = []
    for short, role in ((n, "s"), (n - 1, "l")):
        first = F.floor(short / 2).cast("int")
        for side, half in (("p", F.substring("word", F.lit(1), first)), ("q", F.right("word", short - first))):
            groups.append(F.struct(F.concat_ws(":", short.cast("string"), F.lit(side), half).alias("group"),
                                   short.alias("length"), F.lit(side == "p").alias("by_prefix"), F.lit(role == "l").alias("longer")))
    return F.array(*groups)


def tiles(vocabulary: DataFrame) -> DataFrame:
    """Every word once for each tile it takes part in: its group's block, paired with each of the group's blocks.

    Groups that can hold no pair have no tile. A large group is cut into blocks by hash, so that no tile
    grows with the data.
    """
    keyed = vocabulary.select("word", "n", F.explode(_halves()).alias("_g")).select("word", "n", "_g.*")
    sizes = keyed.groupBy("group").agg(F.count("*").alias("_held"), F.count(F.when(~F.col("longer"), 1)).alias("_short"))
    blocks = F.ceil(F.col("_held") * (F.col("length") + 1) / BLOCK_POINTS).cast("int")
    placed = keyed.join(sizes.where("_held > 1 AND _short > 0"), "group").withColumn("_blocks", blocks).withColumn(
        "_block", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    return met.select(F.concat_ws(":", low.cast("string"), high.cast("string"), "group").alias("tile"), "length", "by_prefix",
                      (F.col("_block") == low).alias("first"), (F.col("_block") == high).alias("second"), "longer", "word", "n")


def _matrices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and the code points of words, aligned left and right; 0 stands where a word has none."""
    raw = np.array([w.encode("latin-1") for w in words])
    width = raw.dtype.itemsize
    left = raw.view(np.uint8).reshape(len(raw), width)
    lengths = np.char.str_len(raw)
    at = np.arange(width)[None, :] - (width - lengths)[:, None]
    right = np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), 1), 0).astype(np.uint8)
    return lengths, left, right


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points each row of `a` has in common with each of `b` from the first column on."""
    width = min(a.shape[1], b.shape[1])
    same = np.ones((len(a), len(b), width + 1), dtype=bool)
    same[:, :, :width] = (a[:, None, :width] == b[None, :, :width]) & (a[:, None, :width] != 0)
    same[:, :, width] = False
    return same.argmin(axis=2)


def near(a: tuple, b: tuple, half: int, by_prefix: bool) -> np.ndarray:
    """Whether each word of `a` is one edit from each of `b`; pairs that share both halves count by prefix only."""
    prefix, suffix = _common(a[1], b[1]), _common(a[2][:, ::-1], b[2][:, ::-1])
    longer, shorter = np.maximum(a[0][:, None], b[0][None, :]), np.minimum(a[0][:, None], b[0][None, :])
    hit = (prefix + suffix >= longer - 1) & ((longer > shorter) | (prefix < longer)) & (longer - shorter <= 1)
    return hit if by_prefix else hit & (prefix < half)


def _tile(word: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray, longer: np.ndarray, length: int, by_prefix: bool) -> list[tuple]:
    """(word, how many near words, the most frequent one's n, that word) of one tile."""
    order = np.lexsort((word, -n))  # the best form stands first
    word, n, first, second, longer = word[order], n[order], first[order], second[order], longer[order]
    lengths, left, right = _matrices(word)
    same = bool((first & second).all())
    count, best = np.zeros(len(word), dtype=np.int64), np.full(len(word), len(word), dtype=np.int64)
    jobs = [(first & ~longer, second & ~longer), (first & ~longer, second & longer)]
    if not same:
        jobs.append((first & longer, second & ~longer))
    for rows, columns in jobs:
        x, y = np.flatnonzero(rows), np.flatnonzero(columns)
        within = same and len(x) == len(y) and bool((x == y).all())
        if not len(x) or not len(y) or (within and len(x) < 2):
            continue
        step = max(1, STEP_POINTS // (len(y) * (left.shape[1] + 1)))
        for at in range(0, len(x), step):
            part = x[at:at + step]
            hit = near((lengths[part], left[part], right[part]), (lengths[y], left[y], right[y]), length // 2, by_prefix)
            rows_hit = hit.any(axis=1)
            count[part] += hit.sum(axis=1)
            best[part[rows_hit]] = np.minimum(best[part[rows_hit]], y[hit.argmax(axis=1)[rows_hit]])
            if not within:  # a block met with itself has each pair in both places
                columns_hit = hit.any(axis=0)
                count[y] += hit.sum(axis=0)
                best[y[columns_hit]] = np.minimum(best[y[columns_hit]], part[hit.argmax(axis=0)[columns_hit]])
    held = np.flatnonzero(count)
    return [(word[i], int(count[i]), int(n[best[i]]), word[best[i]]) for i in held]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles follow one another, each in rows that stand together; a tile may go on in the next batch."""
    columns = ("tile", "length", "by_prefix", "first", "second", "longer", "word", "n")
    held = None

    def solved(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        out = []
        for s, e in zip(starts, ends, strict=True):
            if e - s > 1:
                out += _tile(*(rows[c][s:e] for c in ("word", "n", "first", "second", "longer")), int(rows["length"][s]), bool(rows["by_prefix"][s]))
        names = ("word", "n_near", "form_n", "form")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array([r[i] for r in out], kinds[i]) for i in range(4)], names=list(names))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in columns}
        tile = rows["tile"]
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        if len(starts) > 1:
            yield solved(rows, starts[:-1], starts[1:])
        held = {c: rows[c][starts[-1]:] for c in columns}
    if held is not None:
        yield solved(held, np.array([0]), np.array([len(held["tile"])]))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of words with near words: how many, and the most frequent of them."""
    dealt = tiles(vocabulary).repartition("tile").sortWithinPartitions("tile")
    part = dealt.mapInArrow(_compare, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    met = part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return met.select("word", "n_near", F.col("_best.form").alias("form"), (-F.col("_best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word on the way of forms. Each round doubles the steps taken;
    since a form is several times as frequent as its word, few are needed."""
    held = settle(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = held.select(F.col("word").alias("root"), F.col("root").alias("_next")).where("root <> _next")
        if step.isEmpty():
            return held
        moved = held.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        now = settle(moved)
        discard(held)
        if now.where("moved").isEmpty():
            return now.drop("moved")
        held = now.drop("moved")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, every: int = CUT_EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of the texts.

    `form` is the word's near word of largest n (of ties the smallest), where that is at least `factor` times the
    word's own; `root` is the last word on the way of forms.
    """
    vocabulary = settle(frequent(words(docs, every), least_length, least_count))
    led = vocabulary.join(neighbours(vocabulary), "word", "left")
    good = F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))
    named = settle(led.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                              F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    return named.join(roots(named), "word").select("word", "form", "root", "n", "n_near", "form_n")
