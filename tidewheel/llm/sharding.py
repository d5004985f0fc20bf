"""Balanced shards by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import settle

# Most light items that the last differencing takes, items of one bucket before it, and how many
# times smaller than a shard's mean an item must be to count as light. The last differencing sees at
# most LAST + shards * LIGHT items, whatever the input.
LAST = 8192
BUCKET = 1024
LIGHT = 256
SLOT_ROWS = 512


def difference(sizes: Sequence[int], ways: int) -> np.ndarray:
    """The subset, 0 to ways - 1, of each item.

    Every item starts as a partial partition with one filled subset. The two partial partitions of
    largest spread are joined, the fullest subset of one with the emptiest of the other, until one is
    left. Only the joins' orders are kept; they are unwound at the end.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    sums = {i: np.concatenate([np.zeros(ways - 1, dtype=np.int64), [int(s)]]) for i, s in enumerate(sizes)}
    heap = [(-int(s) if ways > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joins = []
    for node in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = both.argsort(kind="stable")
        sums[node] = both[order]
        joins.append((a, b, order))
        heapq.heappush(heap, (int(both.min() - both.max()), node))
    place = {2 * n - 2: np.arange(ways)}
    for node, (a, b, order) in zip(range(2 * n - 2, n - 1, -1), reversed(joins), strict=True):
        joined = np.empty(ways, dtype=np.int64)
        joined[order] = place.pop(node)
        place[a], place[b] = joined, joined[::-1]
    return np.array([place[i][ways - 1] for i in range(n)], dtype=np.int32)


def _bundle(level: int, ways: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["bytes", "item"], ascending=[False, True])
        found = difference(items["bytes"].tolist(), ways)
        name = f"{level}/{items['bucket'].iloc[0]}/"
        return pd.DataFrame({"item": items["item"], "bytes": items["bytes"], "parent": [name + str(s) for s in found]})

    return run


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(item, bytes) -> (item, shard). Items are light or heavy against a shard's mean. Light ones are
    dealt to buckets of about BUCKET items, each bucket is differenced into `shards` bundles, and the
    bundles are items of the next level, until few enough light items are left. A last differencing
    over those and the heavy ones, at most LAST + shards * LIGHT items in all, runs on the driver.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    floor = total / (shards * LIGHT)
    open_items, tops, parents, level = groups.select("item", "bytes"), [], [], 0
    while True:
        tops.append(open_items.where(F.col("bytes") > floor))
        light = open_items.where(F.col("bytes") <= floor)
        n = light.count()
        if n <= LAST:
            tops.append(light)
            break
        level += 1
        bucket = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(math.ceil(n / BUCKET)))
        linked = settle(light.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
            _bundle(level, shards), "item string, bytes long, parent string"))
        parents.append(linked.select("item", "parent"))
        open_items = settle(linked.groupBy(F.col("parent").alias("item")).agg(F.sum("bytes").alias("bytes")))
    last = sorted(((r["bytes"], r["item"]) for part in tops for r in part.toLocalIterator()), reverse=True)
    found = difference([b for b, _ in last], shards)
    top = spark.createDataFrame([(item, int(s)) for (_, item), s in zip(last, found, strict=True)], "item string, shard int")
    placed = top
    for linked in reversed(parents):
        below = linked.join(placed.withColumnRenamed("item", "parent"), "parent").select("item", "shard")
        placed = below.unionByName(top)
    return placed


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard and its slot there: id, size, text_crc32, shard, slot.

    Rows of equal text stay together; NULL counts as empty. A row weighs its text's UTF-8
    bytes plus 8. Slots run from 0 without gaps in each shard. NULL and repeated ids are rows like any
    other; an empty table gives an empty result; other columns are ignored. Group sizes and counts are
    aggregated before they are shuffled, and groups are attached by a join that adaptive execution can
    split, so one text may make up any share of the rows.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.substring(F.sha2(raw.cast("binary"), 256), 1, 32).alias("item"),
        F.monotonically_increasing_id().alias("_row")))
    groups = settle(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    shard_of = settle(assign_groups(groups, shards).join(groups.select("item", "n"), "item"))
    # One row per shard: at most `shards` rows.
    blocks = shard_of.groupBy("shard").agg(F.ceil(F.sum("n") / SLOT_ROWS).alias("_blocks"))
    placed = settle(rows.join(shard_of.select("item", "shard"), "item").join(F.broadcast(blocks), "shard")
                    .select("doc_id", "size", "text_crc32", "shard", "_row",
                            F.pmod(F.xxhash64("_row"), F.col("_blocks")).alias("_block")))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n")).select(
        "shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "_row")) - 1
    return (placed.withColumn("_at", inside).join(starts, ["shard", "_block"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_at")).cast("bigint").alias("slot")))
