"""Exact Jaccard self-join of word n-gram sets by rare-first prefix filtering, and its components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.components import components
from tidewheel.llm.shingles import mix, shingle_sets
from tidewheel.session import arrow_batches, discard, settle

# The sketch that ranks shingles by how many sets hold them: 2**SKETCH_BITS counts, and in how many rows they travel.
SKETCH_BITS = 20
SKETCH_ROWS = 64
SALTS = 64
# Rows handed to Python at once: each may carry a long text or two sets.
BATCH = 1024
# Bits of the filter that keeps most sets out of the shuffle to their pairs: at most 2**MOST_BITS (16 MB).
MOST_BITS = 27

_U = np.uint64


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: id, set size n and the set's 128-bit hash c1, c2; and, with id NULL and n -1,
    rows of counts of shingles by sketch bucket."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            sizes, sums = [], ([], [])
            for _, bounds, values in shingle_sets(batch.column("text"), width):
                counts += np.bincount(_bucket(values), minlength=len(counts))
                sizes.append(np.diff(bounds))
                for out, salt in zip(sums, (0x51, 0xA7), strict=True):
                    run_sum = np.concatenate([[_U(0)], np.cumsum(mix(values ^ mix(np.array([salt], dtype=np.uint64))), dtype=np.uint64)])
                    out.append((run_sum[bounds[1:]] - run_sum[bounds[:-1]]).view(np.int64))
            rows = batch.num_rows
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, *sums)),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=schema)
        parts = [p for p in enumerate(counts.reshape(SKETCH_ROWS, -1)) if p[1].any()]
        if parts:
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, pa.array([-1] * len(parts), pa.int64()), none, none, pa.array([i for i, _ in parts], pa.int32()),
                 pa.array([c.astype("<i4").tobytes() for _, c in parts], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id long, n long, c1 long, c2 long, part int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The summed counts: 2**SKETCH_BITS numbers (8 MB), whatever the input."""

    def total(kind: str):
        def run(held: pd.DataFrame) -> pd.DataFrame:
            summed = sum(np.frombuffer(c, kind).astype("<i8") for c in held["counts"])
            return pd.DataFrame({"part": held["part"].iloc[:1], "counts": [summed.tobytes()]})

        return run

    salted = parts.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(SALTS)).alias("_salt")).applyInPandas(total("<i4"), "part int, counts binary")
    rows = salted.groupBy("part").applyInPandas(total("<i8"), "part int, counts binary").collect()
    out = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), dtype=np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], "<i8")
    return out.reshape(-1)


def _prefixes(docs: DataFrame, width: int, ranks: Broadcast, num: int, den: int) -> DataFrame:
    """(id, n, prefix): the rarest n - ceil(t n) + 1 shingles of each set, rarest first.

    The order is by sketch count, then by hash: one order for all sets, which is all that a prefix needs to be exact.
    """
    def run(batches):
        for batch in batches:
            sizes, lengths, flat = [], [], []
            for _, bounds, values in shingle_sets(batch.column("text"), width):
                rank = ranks.value[_bucket(values)]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    n = int(b - a)
                    keep = n + (-n * num // den) + 1 if n else 0  # n - ceil(n num / den) + 1
                    order = np.lexsort((values[a:b], rank[a:b]))[:keep]
                    flat.append(values[a:b][order])
                    sizes.append(n)
                    lengths.append(keep)
            if sizes:
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat).view(np.int64)))], names=["id", "n", "prefix"])

    return docs.mapInArrow(run, "id long, n long, prefix array<long>")


def _sets(docs: DataFrame, width: int, ids: DataFrame) -> DataFrame:
    """(id, s): the sorted sets of the given ids, as bytes. A filter of bounded size goes to the scan, an exact join follows."""
    spark, count = docs.sparkSession, ids.count()
    bits = min(MOST_BITS, max(16, (16 * count).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    words = ids.select(F.floor(slot / 64).alias("w"), (slot % 64).cast("int").alias("b")).distinct()
    rows = words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).toLocalIterator()
    table = np.zeros(1 << bits - 6, dtype=np.int64)
    for r in rows:
        table[r["w"]] = r["bits"]
    held = spark.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero((held.value[at >> 6] >> (at & 63)) & 1)
            some = batch.take(pa.array(hit))
            for first, bounds, values in shingle_sets(some.column("text"), width):
                data = [values[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("id").slice(first, len(data)), pa.array(data, pa.binary())], names=["id", "s"])

    found = docs.where("id IS NOT NULL").select("id", "text", slot.alias("slot")).mapInArrow(run, "id long, s binary")
    return found.join(ids, "id", "left_semi")


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """No more than this many members are common: both sets are cut at a middle member, again and again."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    pivot = a[len(a) // 2]
    at = int(np.searchsorted(b, pivot))
    hit = int(at < len(b) and b[at] == pivot)
    return suffix_bound(a[:len(a) // 2], b[:at], depth - 1) + hit + suffix_bound(a[len(a) // 2 + 1:], b[at + hit:], depth - 1)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link; each is checked once."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                need = -(-num * (len(x) + len(y)) // (num + den))  # den I >= num U
                if min(len(x), len(y)) < need or suffix_bound(x, y) < need:
                    keep.append(False)
                else:
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    keep.append(int((both[1:] == both[:-1]).sum()) >= need)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, num: int, den: int) -> Column:
    """Length and positional filters of two sets that share a prefix shingle at places pa_ and pb (from 0)."""
    need = F.ceil((na + nb) * num / (num + den) - 1e-9)
    return (F.least(na, nb) >= need) & (1 + F.least(na - pa_ - 1, nb - pb - 1) >= need)


def link(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row.

    Two documents link when |A n B| / |A u B| >= num / den for their sets of distinct `width`-word shingles; words are
    parted by ASCII white space and A-Z are taken as a-z. class_id is the smallest id with the very same set,
    component_id the smallest id reachable by links. Documents without words are linked with nothing, and
    so are those without an id, whose component is NULL. A repeated id is one document: its rows share their links.
    Shingles are compared by 64-bit hashes, sets of one class by 128 bits. Empty tables give empty results.

    Equal sets are one class, so copies never meet in pairs. Each class's set gives its rarest shingles; a list is
    all classes with one of them. First, every class is paired with the smallest of each of its lists, and linked pairs
    are joined to components. Then, in lists that still hold several components, all pairs from different ones are
    checked: a pair within a component can add nothing. So a group of m near copies costs m pairs and
    not m squared, and no link between components is lost. Pairs pass length and positional filters first.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    with arrow_batches(docs.sparkSession, BATCH):
        rows, classes, final = _linked(docs, width, num, den)
    known = rows.join(classes, ["n", "c1", "c2"], "left")
    out = known.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    # Rows that repeat an id with other sets tie their classes through that id.
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("rep")), F.col("id")).alias("class_id"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def _linked(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, components of class representatives), all written; see link()."""
    profiled = settle(_profiles(docs, width))
    rows = profiled.where("n >= 0").select("id", "n", "c1", "c2")
    classes = settle(rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "c1", "c2").agg(F.min("id").alias("rep")))
    ranks = docs.sparkSession.sparkContext.broadcast(_sketch(profiled.where("n < 0").select("part", "counts")))
    prefixes = settle(_prefixes(docs, width, ranks, num, den).where("n > 0")
                      .join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    ranks.destroy()
    postings = prefixes.select("id", "n", F.posexplode("prefix").alias("at", "shingle"))
    lists = (postings.groupBy("shingle").agg(F.min("id").alias("head"), F.max("id").alias("last"))
             .where("head < last").select("shingle", "head"))
    members = settle(postings.join(lists, "shingle"))
    heads = members.where("id = head").select("shingle", F.col("n").alias("head_n"), F.col("at").alias("head_at"))
    near = _may_link(F.col("n"), F.col("at"), F.col("head_n"), F.col("head_at"), num, den)
    stars = settle(members.where("id <> head").join(heads, "shingle").where(near)
                   .select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    ids = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    links = settle(_verified(stars, _sets(docs, width, ids), num, den))
    joined = settle(components(links))

    placed = members.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_lists = (placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                  .where("lo < hi").select("shingle"))
    left = settle(placed.join(open_lists, "shingle", "left_semi"))
    sizes = left.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    marked = left.join(main, "shingle").select("shingle", "id", "n", "at", "component", "main", (F.col("id") == F.col("head")).alias("star"))
    # Members outside a list's largest component meet all others; two such meet once, smaller id first.
    x, y = marked.where("component <> main").alias("x"), marked.alias("y")
    meets = ((F.col("x.component") != F.col("y.component")) & ~F.col("x.star") & ~F.col("y.star")
             & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
             & _may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), num, den))
    pairs = settle(x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & meets)
                   .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    more = _verified(pairs, _sets(docs, width, ids), num, den)
    final = settle(components(links.unionByName(more)))
    discard(prefixes, members, left, links, stars, pairs)
    return rows, classes, final
