"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A rate above this is split into equal parts whose counts are added: exp(-rate) must not underflow.
PART = 64.0
# Highest count told apart in one part; the mass beyond it is below 1e-30 at the rate PART.
TOP = 256


def unit_hash(*parts: Column) -> Column:
    """A fixed number in [0, 1) from the parts: 52 bits of the MD5 of their texts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(2**52)


def rates(docs: DataFrame, weights: Mapping[str, float], source_col: str, size: Column) -> DataFrame:
    """(source, rate): the mean number of copies that brings each listed source to its target share.

    At most len(weights) rows. The mixed corpus keeps the listed sources' total size.
    """
    if not weights or min(weights.values()) < 0 or not sum(weights.values()) > 0:
        raise ValueError("weights must be non-negative and not all zero")
    held = (docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("held"))
            .where(F.col("source").isin(list(weights))).collect())
    held = {r["source"]: r["held"] or 0 for r in held}
    share = sum(weights[s] for s, n in held.items() if n)
    total = sum(held.values())
    rows = [(s, total * (weights[s] / share) / n if share else 0.0) for s, n in sorted(held.items()) if n]
    return docs.sparkSession.createDataFrame(rows, "source string, rate double")


def _cumulative(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until it no longer grows."""
    term = total = math.exp(-rate)
    out = [total]
    for k in range(1, TOP):
        term *= rate / k
        total += term
        if k > rate and total == out[-1]:
            break
        out.append(total)
    return out


def inversion(rate_rows: DataFrame) -> DataFrame:
    """(source, rate, parts, cumulative): each rate's Poisson distribution as a sorted array, one row a source."""
    rows = []
    for r in rate_rows.collect():
        parts = max(1, math.ceil(r["rate"] / PART))
        rows.append((r["source"], r["rate"], parts, _cumulative(r["rate"] / parts)))
    return rate_rows.sparkSession.createDataFrame(rows, "source string, rate double, parts int, cumulative array<double>")


def replicate(docs: DataFrame, weights: Mapping[str, float], seed: int = 0, id_col: str = "doc_id",
              source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every column of `docs`, one row per copy, plus `copy` (from 0), `copies`, `rate` and `shuffle_key`, in shuffled order.

    `weights` names the target share of each source, by UTF-8 bytes of text plus one a row. A row's
    number of copies is the smallest k with P(count <= k) > u, for its source's Poisson rate and u the
    hash of seed and id: the same on every run, whatever the partitioning. Sources that weights doesn't name, NULL among
    them, are left as they are, one copy a row. Rows without text weigh one byte. Repeated ids draw
    the same count. The order is that of a hash of seed, id and copy; ties go by id, then copy. Columns named like the new ones are replaced.
    An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1
    # At most len(weights) rows of at most TOP numbers: broadcast.
    table = inversion(rates(docs.select(source_col, text_col), weights, source_col, size))
    # The caller's columns travel in one, so that no name can clash.
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"))
    joined = rows.join(F.broadcast(table), F.col("_source") == F.col("source"), "left")
    one = lambda part: F.size(F.filter("cumulative", lambda c: c <= unit_hash(F.lit(seed), F.col("_id"), part)))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + one(part))
    counted = joined.withColumn("copies", F.when(F.col("source").isNull(), 1).otherwise(drawn))
    exploded = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("copy")).cast("binary"))
    key = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").alias("shuffle_key")
    ordered = exploded.select("_row", "_id", "copy", "copies", F.coalesce("rate", F.lit(1.0)).alias("rate"), key).orderBy("shuffle_key", "_id", "copy")
    added = ["copy", "copies", "rate", "shuffle_key"]
    return ordered.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)
