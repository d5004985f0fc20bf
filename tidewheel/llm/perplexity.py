"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import discard, limit_arrow_batches, settle

ORDER = 5
QUANTILE = 0.99
FOLDS = 10  # one in so many trusted documents sets thresholds and isn't trained on
CHARS = 1 << 18  # characters handled at once: what a processor's cache holds
ROWS = 512  # texts turned into Python strings at once
SHARD = 1 << 22  # most n-grams of one shard of probabilities: 48 MB
SLOT_BITS = 21  # n-grams that a task remembers while it counts: at most two million
GRID = 1000  # thresholds are exact on thousandths of a bit
MOST_BITS = 27
LANGUAGES = 8192  # most rows of a table of languages that is sent to all tasks

_U = np.uint64
_PAD = "\n"
_KEYS = [pow(0x9E3779B97F4A7C15, 2 * j + 1, 2**64) for j in range(16)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _pieces(texts: list[str | None], order: int) -> Iterator[tuple[int, str]]:
    """(row, piece): texts with the characters before each piece that its first n-grams need; long ones in several."""
    pad = _PAD * (order - 1)
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), CHARS):
            before = text[at - order + 1:at] if at >= order - 1 else pad[at:] + text[:at]
            yield row, before + text[at:at + CHARS]


def keyed_grams(langs: list[str], texts: list[str | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (row, key, start, codes): every character of every text once, with the 64-bit key of its language and of the
    n-gram that it ends, which starts at codes[start]."""

    def run(held: list[tuple[int, str]]):
        codes = np.frombuffer("".join(p for _, p in held).encode("utf-32-le"), dtype="<u4")
        codes = np.where(codes == 0, 0x10FFFF, codes)  # NUL would end a numpy string
        sizes = np.array([len(p) - order + 1 for _, p in held])
        start = np.arange(sizes.sum()) + np.repeat((order - 1) * np.arange(len(held)), sizes)
        wide, ends = codes.astype(np.uint64), len(codes) - order + 1
        sums = wide[:ends] * _U(_KEYS[0])
        for j in range(1, order):
            sums += wide[j:j + ends] * _U(_KEYS[j])
        key = sums[start] + np.repeat(np.array([_lang_key(langs[r]) for r, _ in held], dtype=np.uint64), sizes)
        return np.repeat(np.array([r for r, _ in held]), sizes), _mix(key).view(np.int64), start, codes

    pending, size = [], 0
    for row, piece in _pieces(texts, order):
        pending.append((row, piece))
        size += len(piece)
        if size >= CHARS:
            yield run(pending)
            pending, size = [], 0
    if pending:
        yield run(pending)


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """(languages, texts) of a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield np.array(some.column("lang").to_pylist(), dtype=object), some.column("text").to_pylist()


def grams(docs: DataFrame, order: int, counted: bool, skip: np.ndarray | None = None) -> DataFrame:
    """(lang, gram, key, n): n-grams of (lang, text) with their counts; or, if not `counted`, each with n 1.

    A task remembers n-grams in a table of fixed size, one to a slot; those are counted there and given out once. An n-gram
    whose slot another one holds is given out with each run's count. Without counts, most n-grams whose keys are in
    `skip` are left out.
    """
    passed = None if skip is None else docs.sparkSession.sparkContext.broadcast(skip)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
    shift = _U(64 - SLOT_BITS)

    def batch_of(langs: list[np.ndarray], codes: list[np.ndarray], key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        spelled = np.ascontiguousarray(np.concatenate(codes)).astype("<u4").view(f"<U{order}").reshape(-1)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(langs), pa.string()), pa.array(spelled.tolist(), pa.string()), pa.array(key), pa.array(n)], schema=schema)

    def run(batches):
        held, taken = np.zeros(1 << SLOT_BITS, dtype=np.int64), np.zeros(1 << SLOT_BITS, dtype=bool)
        counts = np.zeros(1 << SLOT_BITS if counted else 0, dtype=np.int64)
        if passed is not None:
            place = (passed.value.view(np.uint64) >> shift).astype(np.int64)
            held[place], taken[place] = passed.value, True
        hits, slots_of, langs_of, codes_of = [], [], [], []
        for langs, texts in _some_rows(batches):
            for row, key, start, codes in keyed_grams(langs.tolist(), texts, order):
                slot = (key.view(np.uint64) >> shift).astype(np.int64)
                known = taken[slot] & (held[slot] == key)
                if counted:
                    hits.append(slot[known])
                    if sum(map(len, hits)) > len(counts):
                        counts += np.bincount(np.concatenate(hits), minlength=len(counts))
                        hits = []
                rest = np.flatnonzero(~known)
                by = rest[np.argsort(key[rest])]
                ordered = key[by]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(by) else by
                kinds, n, at = ordered[first], np.diff(np.append(first, len(ordered))), by[first]
                place = (kinds.view(np.uint64) >> shift).astype(np.int64)
                # The first n-gram of each free slot takes it.
                lead = np.zeros(len(kinds), dtype=bool)
                lead[np.unique(place, return_index=True)[1]] = True
                lead &= ~taken[place]
                held[place[lead]], taken[place[lead]] = kinds[lead], True
                out = ~lead if counted else np.ones(len(kinds), dtype=bool)
                letters = lambda pick: codes[start[at[pick]][:, None] + np.arange(order)]
                if counted:
                    counts[place[lead]] += n[lead]
                    slots_of.append(place[lead])
                    langs_of.append(langs[row[at[lead]]])
                    codes_of.append(letters(lead))
                if out.any():
                    yield batch_of([langs[row[at[out]]]], [letters(out)], kinds[out], n[out])
        if slots_of:
            slots = np.concatenate(slots_of)
            counts += np.bincount(np.concatenate([slots[:0], *hits]), minlength=len(counts))
            yield batch_of(langs_of, codes_of, held[slots], counts[slots])

    rows = docs.mapInArrow(run, "lang string, gram string, key long, n long").groupBy("lang", "gram", "key")
    return rows.agg(F.sum("n").alias("n")) if counted else rows.agg(F.lit(1).alias("n"))


def _orders(top: DataFrame, order: int) -> list[DataFrame]:
    """(lang, gram, n) of each order from 1 up: raw counts at the top, and below it how many letters each n-gram follows."""
    out = [top.select("lang", "gram", "n")]
    for _ in range(order - 1):
        out.insert(0, settle(out[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    return out


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): a language's discounts for counts of 1, 2 and more; 0.5, 1 and 1.5 where its counts of counts can't tell."""
    ones = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    found = counts.groupBy("lang").agg(*ones)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    raw = [F.try_subtract(F.lit(float(i)), (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))) for i in (1, 2, 3)]
    fine = F.lit(True)
    for i, d in enumerate(raw, 1):
        fine = fine & F.coalesce((d > 0) & (d < i), F.lit(False))
    fine = (F.col("n1") > 0) & (F.col("n2") > 0) & fine
    return found.select("lang", *[F.when(fine, d).otherwise(F.lit(0.5 * i)).alias(f"d{i}") for i, d in enumerate(raw, 1)])


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _beside(languages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables of one row a language meet those of n-grams: as broadcasts up to LANGUAGES rows (1 MB), so that n-grams stay
    where they are and aren't dealt by language, of which there are few. Beyond that by a shuffle, which then has many keys."""
    return F.broadcast if languages.limit(LANGUAGES + 1).count() <= LANGUAGES else lambda table: table


def probabilities(top: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(key, bits) of each wanted (lang, gram, key): minus log2 of the last letter's probability after the others.

    Each order's probability is its discounted count over its context's, plus what the context's discounts leave over
    times the next lower order's; the lowest is mixed with an even spread over the language's letters and one unknown. All
    are joins sharded by language and n-gram. Languages that weren't trained on have no rows.
    """
    levels = _orders(top, order)
    asked = [settle(wanted.select("lang", "gram").distinct())]
    for _ in range(order - 1):
        asked.insert(0, settle(asked[0].select("lang", F.expr("substring(gram, 2)").alias("gram")).distinct()))
    letters = levels[0].groupBy("lang").agg((F.count("*") + 1).alias("letters"))
    beside = _beside(letters)
    lower = asked[0].join(beside(letters), "lang").select("lang", "gram", (F.lit(1.0) / F.col("letters")).alias("p"))
    for size, (counts, grams_asked) in enumerate(zip(levels, asked, strict=True), 1):
        known = counts.join(beside(_discounts(counts)), "lang").withColumn("d", _discount(F.col("n")))
        context = F.expr(f"substring(gram, 1, {size - 1})")
        contexts = known.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        seen = known.select("lang", "gram", (F.col("n") - F.col("d")).alias("held"))
        below = lower
        joined = grams_asked.withColumn("context", context).withColumn("suffix", F.expr("substring(gram, 2)"))
        joined = joined.join(seen, ["lang", "gram"], "left").join(contexts, ["lang", "context"], "left")
        joined = joined.join(below if size == 1 else below.withColumnRenamed("gram", "suffix"), ["lang", "gram" if size == 1 else "suffix"])
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise(
            (F.coalesce("held", F.lit(0.0)) + F.col("left") * F.col("p")) / F.col("total"))
        lower = settle(joined.select("lang", "gram", p.alias("p")))
        discard(below, grams_asked)
    return wanted.join(lower, ["lang", "gram"]).select("key", (-F.log2("p")).alias("bits"))


def _lookup(keys: np.ndarray, bits: np.ndarray):
    """key array -> bits, 0 for keys that aren't there.

    A table has a slot for every value of the keys' high bits, and of the keys that share one the likeliest stands
    in it, beside its bits; the others are found in their sorted order.
    """
    width = max(4, (2 * len(keys)).bit_length())
    shift = _U(64 - width)
    slot_of = lambda k: (k.view(np.uint64) >> shift).astype(np.int64)
    table, beside = ~np.arange(1 << width, dtype=np.int64) << np.int64(64 - width), np.zeros(1 << width)  # keys that can't come to their slots
    likely = np.argsort(-bits, kind="stable")  # of equal slots the last assignment stays
    slots = slot_of(keys[likely])
    table[slots], beside[slots] = keys[likely], bits[likely]
    order = np.argsort(keys)
    keys, bits = keys[order], bits[order]

    def find(asked: np.ndarray) -> np.ndarray:
        slot = slot_of(asked)
        out = beside[slot]
        other = np.flatnonzero(table[slot] != asked)
        if len(other):
            out[other] = 0.0
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked[other]), len(keys) - 1)
                hit = keys[at] == asked[other]
                out[other[hit]] = bits[at[hit]]
        return out

    return find


def _score(docs: DataFrame, table: DataFrame, order: int, text_col: str) -> DataFrame:
    """Adds to `_bits` of (_row, _lang, _bits) the bits of every character of `text_col` in _row. One pass goes over the rows for each shard of
    at most SHARD probabilities, which that pass's tasks hold whole; the passes form one stage."""
    spark, total = docs.sparkSession, table.count()
    shards = max(1, math.ceil(1.1 * total / SHARD))
    for s in range(shards):
        part = table.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == s).toArrow()
        held = spark.sparkContext.broadcast((part["key"].to_numpy(), part["bits"].to_numpy()))
        del part
        pa.default_memory_pool().release_unused()  # the driver keeps nothing of the shard

        def run(batches, held=held):
            find = _lookup(*held.value)
            for batch in batches:
                sums = batch.column("_bits").to_numpy(zero_copy_only=False).copy()
                langs, texts = batch.column("_lang"), pc.struct_field(batch.column("_row"), text_col)
                for at in range(0, batch.num_rows, ROWS):
                    some = slice(at, at + ROWS)
                    for row, key, _, _ in keyed_grams(langs[some].to_pylist(), texts[some].to_pylist(), order):
                        sums[some] += np.bincount(row, weights=find(key), minlength=len(sums[some]))
                yield batch.set_column(batch.schema.get_field_index("_bits"), "_bits", pa.array(sums))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _near_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` (id, ...) whose id is in `ids` (id, fold), with the fold: a bit table of bounded size keeps most other
    texts out of the shuffle, the join is exact."""
    bits = min(MOST_BITS, max(16, (16 * ids.count()).bit_length()))
    slot = lambda: F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    words = ids.select(F.floor(slot() / 64).alias("w"), (slot() % 64).cast("int").alias("b")).distinct()
    table = np.zeros(1 << bits - 6, dtype=np.int64)
    for r in words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).toLocalIterator():
        table[r["w"]] = r["bits"]
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            at = batch.column("_slot").to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(((held.value[at >> 6] >> (at & 63)) & 1).astype(bool))).drop_columns(["_slot"])

    source = docs.where("id IS NOT NULL")
    return source.withColumn("_slot", slot()).mapInArrow(run, source.schema).join(ids, "id")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of `docs`, and perplexity, threshold and kept.

    Trusted text is that of documents whose labels all have quality 1 and toxic 0. Of it, nine in ten documents, chosen by a hash of
    the id, train one character model per language, without any bound; the rest are held out. A language's threshold is the
    `quantile` of its held-out documents' bits a character, exact on a grid of 1/1000 bit. A document is kept unless its
    bits are above its language's threshold. Perplexity is per character, over the whole text.

    Documents without text, NULL or empty, have no perplexity and are not kept. Languages (NULL is one) without trusted
    text or held-out documents can't be judged: perplexity or threshold is NULL and all documents with text are kept. NULL
    labels and ids are passed over; repeated rows are judged alike, and repeated trusted rows each count. Columns of
    `docs` named like the new ones are replaced. An empty table gives an empty result.
    """
    limit_arrow_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    trusted = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
               .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"), F.count(F.when(F.col("quality").isNull() | F.col("toxic").isNull(), 1)).alias("unknown"))
               .where("q = 1 AND t = 0 AND unknown = 0").select("id", (F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0).alias("held_out")))
    plain = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    known = settle(_near_ids(plain.where(F.length("text") > 0), settle(trusted)).select("lang", "text", "held_out"))
    top = settle(grams(known.where("NOT held_out").select("lang", "text"), order, True))
    # Trained n-grams are wanted anyway. Up to SHARD of their keys (32 MB) spare the tasks from asking for them again.
    parts = max(1, math.ceil(1.1 * top.count() / SHARD))
    trained = top.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == 0).select("key").toArrow()["key"].to_numpy()
    others = grams(plain.where(F.length("text") > 0).select("lang", "text"), order, False, trained)
    wanted = settle(others.select("lang", "gram", "key").union(top.select("lang", "gram", "key")).distinct())
    table = settle(probabilities(top, wanted, order))
    discard(top, wanted)

    # The caller's columns travel in one, so that no name can clash and texts travel once.
    def scored(rows: DataFrame, name: str) -> DataFrame:
        """bits a character, on the grid, of rows (_row, _lang)."""
        size = F.length(F.col("_row")[name])
        summed = _score(rows.withColumn("_bits", F.lit(0.0)), table, order, name)
        return summed.withColumn("_bits", F.when((size > 0) & (F.col("_bits") > 0), F.ceil(F.col("_bits") / size * GRID)))

    tested = scored(known.where("held_out").select(F.struct("text").alias("_row"), F.col("lang").alias("_lang")), "text")
    bins = tested.where("_bits IS NOT NULL").groupBy("_lang", "_bits").agg(F.count("*").alias("n"))
    up = Window.partitionBy("_lang").orderBy("_bits")
    ranked = bins.withColumn("_below", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(Window.partitionBy("_lang")))
    limits = settle(ranked.where(F.col("_below") >= F.lit(quantile) * F.col("_all")).groupBy("_lang").agg(F.min("_bits").alias("_limit")))
    discard(known)
    judged = scored(docs.select(F.struct("*").alias("_row"), lang.alias("_lang")), text_col).join(limits, "_lang", "left")
    columns = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("perplexity", "threshold", "kept")]
    has_text = F.coalesce(F.length(F.col("_row")[text_col]) > 0, F.lit(False))
    return judged.select(*columns, F.pow(F.lit(2.0), F.col("_bits") / GRID).alias("perplexity"), F.pow(F.lit(2.0), F.col("_limit") / GRID).alias("threshold"),
                         (has_text & F.coalesce(F.col("_bits") <= F.col("_limit"), F.lit(True))).alias("kept"))
