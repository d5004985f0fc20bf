"""Exact percentiles of groups of any size.

The built-in exact `percentile` keeps every distinct value of a group in one aggregation
buffer. Here groups of few values are sorted as arrays; for the others a mergeable sketch
brackets each wanted rank, rows outside the brackets are only counted, and the rank is then
found exactly among the few values inside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.blocks import join_keys, prefix

_SUB = 4096
#: Values of a group that are gathered in one array.
SMALL = 4096


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    kind: str = "linear",
    accuracy: int = 1000,
    small: int = SMALL,
) -> DataFrame:
    """One row per group: `{name: p}` as columns, plus nothing else but the keys.

    kind "linear" interpolates between ranks around p*(n-1); "nearest" takes rank
    floor(p*(n-1) + 0.5). NULL values do not take part; NULL keys are groups. The plan is the same
    for groups of every size, and building it runs no job. Groups of up to `small` values take the short way.
    """
    keys = list(keys)
    slack = 4.0 / accuracy
    wanted = sorted(set(probs.values()))
    edges = [e for p in wanted for e in (max(0.0, p - slack), min(1.0, p + slack))]
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if keys:
        sizes = values.groupBy(*keys).agg(F.count("*").alias("_size"))
        sized = join_keys(values, sizes, keys)
        gathered = sized.where(F.col("_size") <= small).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("_v") + 0.0)).alias("_s"))
        values = sized.where(F.col("_size") > small).drop("_size")
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("_q"),
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # A small group (where the slack is under a few ranks) is bracketed whole, and so are the
    # lowest and highest ranks of any group by the true extremes.
    whole = F.col("_n") * slack < 4.0

    def edge(k: int, end: float, extreme: str):
        return F.col(extreme) if edges[k] == end else F.when(whole, F.col(extreme)).otherwise(F.col("_q")[k])

    lows = [edge(2 * i, 0.0, "_min") for i in range(len(wanted))]
    highs = [edge(2 * i + 1, 1.0, "_max") for i in range(len(wanted))]
    brackets = sketch.select(*keys, "_n", *[c.alias(f"_lo{i}") for i, c in enumerate(lows)],
                             *[c.alias(f"_hi{i}") for i, c in enumerate(highs)])

    v = F.col("_v")
    slot = sum((F.when(v > F.col(f"_hi{i}"), 1).otherwise(0) for i in range(len(wanted))), F.lit(0))
    inside, sub = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    for i in reversed(range(len(wanted))):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        here = F.col("_slot") == i
        inside = F.when(here, F.when(v >= lo, v)).otherwise(inside)
        sub = F.when(here & (v >= lo), F.lit(1) + F.floor(
            F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0) * _SUB)).otherwise(sub)
    # Without keys the brackets are one row.
    placed = join_keys(values, brackets, keys) if keys else values.crossJoin(F.broadcast(brackets))
    counted = (
        placed
        .withColumn("_slot", slot)
        .withColumn("_sub", (F.col("_slot") * (_SUB + 4) + sub).cast("bigint"))
        .withColumn("_val", inside)
        .groupBy(*keys, "_slot", "_sub", "_val").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    )
    ranked = prefix(counted, keys, {"_cum": ("sum", "_c")}, order=["_slot", "_sub", "_val"], block=F.col("_sub"))

    def at(rank):
        return F.max(F.when((rank >= F.col("_cum") - F.col("_c")) & (rank < F.col("_cum")), F.col("_val")))

    aggs = []
    for i, p in enumerate(wanted):
        position = F.lit(p) * (F.col("_n") - 1)
        if kind == "nearest":
            aggs += [at(F.floor(position + 0.5)).alias(f"_a{i}")]
        else:
            aggs += [at(F.floor(position)).alias(f"_a{i}"), at(F.ceil(position)).alias(f"_b{i}")]
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    out = {}
    for i, p in enumerate(wanted):
        miss = F.raise_error(F.lit(f"rank bracket for p={p} missed")).cast("double")
        a = F.coalesce(F.col(f"_a{i}"), miss)
        if kind == "nearest":
            out[p] = a
        else:
            b = F.coalesce(F.col(f"_b{i}"), miss)
            position = F.lit(p) * (F.col("_n") - 1)
            out[p] = a + (b - a) * (position - F.floor(position))
    bracketed = found.select(*keys, *[out[p].alias(name) for name, p in probs.items()])
    if not keys:
        return bracketed
    for p in wanted:
        position = F.lit(p) * (F.size("_s") - 1)
        place = lambda rank: F.get("_s", rank.cast("int"))
        if kind == "nearest":
            out[p] = place(F.floor(position + 0.5))
        else:
            a, b = place(F.floor(position)), place(F.ceil(position))
            out[p] = a + (b - a) * (position - F.floor(position))
    return bracketed.unionByName(gathered.select(*keys, *[out[p].alias(name) for name, p in probs.items()]))


def median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_percentiles(df, keys, value, {out: 0.5})
