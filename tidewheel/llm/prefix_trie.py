"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. Conversations are hashed turn by turn (128 bits, by running exclusive
or of hashes of turn and place), so nodes are groups of equal hashes and no conversation is ever one row. Totals of
subtrees come from rounds of joins: *rake* adds every leaf to its parent and takes it away, *compress* takes nodes of
one child out of their chain, no two neighbours in a round, and lets the child carry what it stood for. A chain of
n nodes is gone in about log n rounds. In the end the nodes taken out are expanded again, last round first.

Results where the data are odd: rows without a conv_id belong to no conversation and are left out; a NULL turn comes
first; equal turns go by role, then by the SHA-256 of role and text; repeated rows are turns of their own. NULL role
and text read as empty. Texts of any length enter as their hashes. An empty table has no nodes. Further columns of
any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.turns import placed
from tidewheel.session import discard, settle

#: Turns of one conversation hashed in a row, and the range of conv_ids that one row of an end list covers.
RUN, IDS = 4096, 4096
#: Shared openings: conversations come in families of so many, with less than so many turns of the first one.
FAMILY, MOST_SHARED = 5, 9


def turn_digest() -> Column:
    """SHA-256 of a turn's role and text, which can't run into one another."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, digest, bytes of the text) of every turn."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), turn_digest().alias("digest"), size.alias("bytes"))
    return placed(rows, ["conv_id"], ["turn", "role", "digest"]).select("conv_id", "position", "digest", "bytes")


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c: the first h turns of conversation c - c % 5, then its own after its first h, with h
    the CRC-32 of c in decimal modulo 9. Gives the turns, with the length of their conversation, and (conv_id, length).
    """
    held = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h")
    first = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first")
    plan = held.select("conv_id", "n", h, first).join(held.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first")), "first", "left")
    taken = F.least("h", F.coalesce("n_first", F.lit(0).cast("bigint")))
    plan = settle(plan.select("conv_id", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(plan, "conv_id").where("position > h").withColumn("position", F.expr("position - h + taken"))
    heads = turns.where(F.col("position") < MOST_SHARED).withColumnRenamed("conv_id", "first")
    given = heads.join(plan, "first").where("position <= taken")
    cols = ("conv_id", "position", "digest", "bytes", "length")
    return own.select(*cols).unionByName(given.select(*cols)), plan.select("conv_id", "length")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Add the hash of all turns up to each (k1, k2) and of all before it (p1, p2), run by run and then over the runs."""
    own = {"_h1": F.xxhash64("digest", "position"), "_h2": F.xxhash64("position", "digest")}
    rows = turns.withColumns(own).withColumn("_run", F.floor((F.col("position") - 1) / RUN))
    inside = Window.partitionBy("conv_id", "_run").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv_id", "_run").agg(F.bit_xor("_h1").alias("_t1"), F.bit_xor("_h2").alias("_t2"))
    carry = runs.select("conv_id", "_run", F.bit_xor("_t1").over(before).alias("_c1"), F.bit_xor("_t2").over(before).alias("_c2")).where("_run > 0")
    led = rows.withColumns({f"_l{i}": F.bit_xor(f"_h{i}").over(inside) for i in (1, 2)}).join(carry, ["conv_id", "_run"], "left")
    keyed = led.withColumns({f"k{i}": F.col(f"_l{i}").bitwiseXOR(F.coalesce(f"_c{i}", F.lit(0))) for i in (1, 2)})
    return keyed.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"_h{i}")) for i in (1, 2)}).drop(
        "_h1", "_h2", "_run", "_l1", "_l2", "_c1", "_c2")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's lists of ids stand together and in order; the hash runs on from list to list."""
    node, state, out = None, None, []

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["depth", "k1", "k2", "ends_sha256"]
        return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")]
        for depth, k1, k2, ids in zip(*columns, strict=True):
            if (depth, k1, k2) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield made(out)
        out = []
    if node is not None:
        yield made([(*node, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id) -> the SHA-256 of each node's ids in numeric order, comma-joined.

    Ids are joined by ranges first. A hash is sequential by nature, so a node's lists go through one task, one at a time.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = ends.groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / IDS).alias("range")).agg(ids.alias("ids"))
    node = ["depth", "k1", "k2"]
    return lists.repartition(*node).sortWithinPartitions(*node, "range").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: its smallest member, members, children, bytes of its last text, its parent and its ends' digest."""
    rows = settle(prefix_hashes(turns).withColumnRenamed("position", "depth").drop("digest"))
    zero = F.lit(0).cast("bigint")
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    inner = rows.groupBy("depth", "k1", "k2").agg(*members, F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = lengths.agg(*members).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("bytes"),
        F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"))
    held = settle(inner.unionByName(root))
    ended = rows.where("depth = length").select("depth", "k1", "k2", "conv_id").unionByName(
        lengths.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    above = held.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = above.groupBy("depth", "k1", "k2").agg(F.count("*").alias("n_children"))
    key = ["depth", "k1", "k2"]
    known = held.join(children, key, "left").join(end_digests(ended), key, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))})
    parents = held.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return known.join(parents, ["depth", "p1", "p2"], "left").drop("k1", "k2", "p1", "p2")


def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, and for each of `values` its sum over the node's subtree) of a forest.

    `tree` has node, parent (NULL at a root), n_children, depth (growing from parent to child) and the values. Each round
    is two written tables; what is live shrinks by a constant share at least, so all rounds together cost a few times the first.
    """
    own, hung = [f"_v{i}" for i in range(len(values))], [f"_p{i}" for i in range(len(values))]
    zero = F.lit(0).cast("bigint")
    live = settle(tree.select("node", "parent", F.col("n_children").alias("n"), "depth", *[F.col(v).alias(o) for v, o in zip(values, own, strict=True)],
                              *[zero.alias(p) for p in hung]))
    deepest = live.agg(F.max("depth")).first()[0] or 0
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not live.where("parent IS NOT NULL").isEmpty():
        # Rake: leaves give their totals, and what hangs on their edges, to their parents.
        leaf, inner = F.col("n") == 0, F.col("n") > 0
        gathered = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.when(inner, 1)).alias("n"), F.min(F.when(inner, F.col("node"))).alias("only"),
            *[F.sum(F.when(leaf, F.col(o) + F.col(p))).alias(f"_a{o}") for o, p in zip(own, hung, strict=True)])
        raked = live.where(inner).drop("n").join(gathered, "node").withColumns({o: F.col(o) + F.coalesce(f"_a{o}", zero) for o in own})
        mid = settle(raked.select("node", "parent", "n", "only", "depth", *own, *hung))
        # Compress: nodes of one child leave their chains where their coin shows heads and the child's does not.
        bit = len(rounds)
        coin = F.shiftright("depth", bit) if deepest >> bit else F.xxhash64("node", F.lit(bit))
        heads = mid.where("n = 1 AND parent IS NOT NULL").where(coin.bitwiseAND(F.lit(1).cast("bigint")) == 1)
        cut = heads.join(heads.select(F.col("node").alias("only")), "only", "left_anti").select(
            F.col("node").alias("_gone"), F.col("only").alias("node"), F.col("parent").alias("_above"),
            *[F.col(o).alias(f"_g{o}") for o in own], *[F.col(p).alias(f"_g{p}") for p in hung])
        stay = mid.join(cut.select(F.col("_gone").alias("node")), "node", "left_anti").join(cut, "node", "left")
        gone = F.col("_gone").isNotNull()
        after = settle(stay.select(
            "node", F.when(gone, F.col("_above")).otherwise(F.col("parent")).alias("parent"), "n", "depth", *own,
            *[F.when(gone, F.col(p) + F.col(f"_g{o}") + F.col(f"_g{p}")).otherwise(F.col(p)).alias(p) for o, p in zip(own, hung, strict=True)],
            "_gone", *[(F.col(f"_g{o}") + F.col(p)).alias(f"_w{o}") for o, p in zip(own, hung, strict=True)]))
        discard(mid)
        rounds.append((live, after))
        live = after.drop("_gone", *[f"_w{o}" for o in own])
    # Expand: a leaf's total was its own when it was raked; a node cut out adds to the total of the child that took its place.
    known = live.select("node", *own)
    for before, after in reversed(rounds):
        cut = after.where("_gone IS NOT NULL").select("_gone", "node", *[f"_w{o}" for o in own])
        found = settle(cut.join(known, "node").select(F.col("_gone").alias("node"), *[(F.col(o) + F.col(f"_w{o}")).alias(o) for o in own]))
        known = known.unionByName(found).unionByName(before.where("n = 0").select("node", *own))
    return known.select("node", *[F.col(o).alias(v) for v, o in zip(values, own, strict=True)])


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the prefix trie of the conversations rebuilt with shared openings.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, and over the subtree n_leaves and saved_tokens: what
    the members beyond the first of each node would repeat, in bytes of its last text; ends_sha256 of the members that end there.
    """
    turns, lengths = with_shared_openings(settle(numbered(conversations)))
    held = settle(nodes(turns, lengths).withColumns({
        "node": F.struct("conv_id", "depth"),
        "parent": F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))),
        "n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    totals = subtree_totals(held, ["n_leaves", "saved_tokens"])
    return held.drop("n_leaves", "saved_tokens").join(totals, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
