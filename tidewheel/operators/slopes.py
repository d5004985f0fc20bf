"""Median of all pairwise slopes (Theil-Sen) of groups of any size, without listing the pairs.

The number of pairs with a slope of at most s is the number of pairs that y - s*x puts in falling order, so the median
is found by counting such pairs for a few s and narrowing them down. A group of up to ROWS rows is
one array and is counted in place. A larger one is cut by rank of x into blocks, and each round is a Spark job that
counts pairs inside blocks, pairs of different blocks in one range of y - s*x, and pairs of different
blocks and ranges from the blocks' histograms. No task holds more than a block, a range or a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.operators.blocks import number_rows
from tidewheel.session import discard, settle

#: Rows of a group that is counted in place, and of a block of a larger one; rows that set the ranges; most ranges.
ROWS, SAMPLED, RANGES = 65_536, 4_096, 512
#: Slopes closer than this, relative to their size or to 1, are one.
CLOSE = 1e-13


def falling_pairs(group: np.ndarray, z: np.ndarray, weight: np.ndarray) -> int:
    """Weight of pairs i, j with group[i] < group[j] and z[i] >= z[j]; a pair weighs the product of its two weights.

    At each width every right half is looked up in its left half, which is sorted with running weights.
    """
    rank = np.unique(z, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((rank, group))
    group, seq, weight = group[order], rank[order], weight[order].astype(np.int64)
    span = int(seq.max()) + 1 if len(seq) else 1
    place = np.arange(len(seq))
    count, width = 0, 1
    while width < len(seq):
        pair, is_left = place // (2 * width), (place // width) % 2 == 0
        spots = pair[is_left] * span + seq[is_left]
        sort = np.argsort(spots, kind="stable")
        left, running = spots[sort], np.concatenate([[0], np.cumsum(weight[is_left][sort])])
        above = np.searchsorted(left, (pair[~is_left] + 1) * span)
        here = np.searchsorted(left, pair[~is_left] * span + seq[~is_left])
        count += int(np.sum(weight[~is_left] * (running[above] - running[here])))
        width *= 2
    # Inside a group z ascends, so of its own pairs only ties were counted.
    new = np.ones(len(seq), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (seq[1:] != seq[:-1])
    starts = np.flatnonzero(new)
    if len(starts):
        sums, squares = np.add.reduceat(weight, starts), np.add.reduceat(weight * weight, starts)
        count -= int(np.sum((sums * sums - squares) // 2))
    return count


def _rest(x: np.ndarray, y: np.ndarray, slope: float) -> np.ndarray:
    """What a line of this slope leaves; points on one line are equal up to rounding."""
    return np.round(y - slope * x, 12)


def _ordered(value: float) -> int:
    """Doubles as integers in the same order, so that halving works at every scale."""
    bits = int(np.float64(value + 0.0).view(np.int64))
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def _double(order: int) -> float:
    return float(np.int64(order).view(np.float64)) if order >= 0 else -float(np.int64(-order).view(np.float64))


_LARGEST = float(np.finfo(np.float64).max)


def tries_between(low: float, high: float, k: int, at_low: int | None, at_high: int | None) -> list[float]:
    """Slopes to try for the k-th, of which the counts at both ends are given where known; none when the ends are close.

    One halves [low, high] in the order of doubles, whatever the slopes are; three stand about the place where a straight line
    between the counts would put the k-th, which leaves little of the interval where slopes are spread evenly.
    """
    if high - low <= CLOSE * max(1.0, abs(low), abs(high)):
        return []
    tries = {_double((_ordered(low) + _ordered(high)) // 2)}
    if at_low is not None and at_high is not None and high - low < _LARGEST:
        centre = low + (high - low) * (k - 0.5 - at_low) / (at_high - at_low)
        tries |= {centre + step * (high - low) for step in (-1 / 128, 0.0, 1 / 128)}
    return sorted(t for t in tries if low < t < high)


#: Up to so many points all slopes are laid out at once, which takes no rounds.
FEW = 256


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The median slope of one array of points; 0 when no two differ in x."""
    if len(x) <= FEW:
        i, j = np.triu_indices(len(x), 1)
        run = x[j] - x[i]
        return float(np.median((y[j] - y[i])[run != 0] / run[run != 0])) if (run != 0).any() else 0.0
    ones = np.ones(len(x), dtype=np.int64)
    same = np.unique(x, return_counts=True)[1].astype(np.int64)
    total = (len(x) ** 2 - int(np.sum(same * same))) // 2
    if total == 0:
        return 0.0
    # A first bracket: no slope is steeper than the whole rise over the smallest step.
    steepest = float(np.ptp(y)) / float(np.diff(np.unique(x)).min())
    found = []
    for k in {(total + 1) // 2, total // 2 + 1}:
        low, high = -steepest, steepest
        while True:
            middle = 0.5 * (low + high)
            if middle in (low, high) or high - low <= CLOSE * max(1.0, abs(low), abs(high)):
                break
            if falling_pairs(x, _rest(x, y, middle), ones) >= k:
                high = middle
            else:
                low = middle
        found.append(high)
    return float(np.mean(found))


@F.pandas_udf(T.DoubleType())
def _median_of(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([median_slope(a, b) for a, b in zip(x, y)])


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "slope") -> DataFrame:
    """Median of pairwise slopes per group; 0 when there are none. NULLs are passed over."""
    keys = list(keys)
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.struct(*keys).alias("_g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = settle(points)
    large = settle(points.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS))
    small = points
    if any_large := not large.isEmpty():
        small = points.join(large.select("_g"), "_g", "left_anti")
    solved = small.groupBy("_g").agg(F.collect_list(F.struct("x", "y")).alias("_p")).select("_g", _median_of("_p.x", "_p.y").alias(out))
    if any_large:
        solved = solved.unionByName(_by_rounds(points.join(large, "_g"), out))
    return solved.select(*[F.col("_g")[k].alias(k) for k in keys], out)


# ---- large groups
def _by_rounds(points: DataFrame, out: str) -> DataFrame:
    """(_g, x, y, _n) -> (_g, slope)."""
    weighed = settle(points.groupBy("_g", "x", "y").agg(F.count("*").alias("w"), F.max("_n").alias("_n"))
                     .repartitionByRange("_g", "x", "y").withColumn("_range", F.spark_partition_id()))
    ranked = number_rows(weighed, ["_g"], ["x", "y"], F.col("_range"), "_rank")
    blocks = settle(ranked.groupBy("_g", F.floor((F.col("_rank") - 1) / ROWS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("x", "y", "w"))).alias("points")))
    by_x = weighed.groupBy("_g", "x").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    totals = by_x.groupBy("_g").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss")).select(
        "_g", F.floor((F.col("s").cast("decimal(19,0)") * F.col("s").cast("decimal(19,0)") - F.col("ss")) / 2).cast("decimal(38,0)").alias("pairs"))
    near = F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("_n") / SAMPLED)) == 0
    sample = weighed.where(near).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("sample"))
    shape = settle(blocks.groupBy("_g").agg(F.count("*").alias("n_blocks")).join(sample, "_g", "left"))
    two = F.array_distinct(F.array(*[m.cast("decimal(38,0)") for m in (F.floor((F.col("pairs") + 1) / 2), F.floor(F.col("pairs") / 2) + 1)]))
    count = lambda: F.lit(None).cast("decimal(38,0)")
    state = settle(totals.where("pairs > 0").select("_g", F.explode(two).alias("k"), F.lit(-_LARGEST).alias("low"), F.lit(_LARGEST).alias("high"), count().alias("at_low"), count().alias("at_high"))
                   .join(shape.select("_g", "sample"), "_g", "left").withColumn("tries", _first_tries("sample.x", "sample.y")).drop("sample"))
    none = totals.where("pairs = 0").select("_g", F.lit(0.0).alias(out))
    while not state.where(F.size("tries") > 0).isEmpty():
        tried = state.where(F.size("tries") > 0).select("_g", "k", F.explode("tries").alias("s"))
        counts = _counts(blocks, shape, tried.select("_g", "s").distinct())
        under, pair = F.col("pairs") < F.col("k"), F.struct("s", "pairs")
        seen = tried.join(counts, ["_g", "s"]).groupBy("_g", "k").agg(F.max(F.when(under, pair)).alias("above"), F.min(F.when(~under, pair)).alias("below"))
        moved = state.join(seen, ["_g", "k"], "left").select(
            "_g", "k", F.coalesce("above.s", "low").alias("low"), F.coalesce("below.s", "high").alias("high"),
            F.coalesce("above.pairs", "at_low").alias("at_low"), F.coalesce("below.pairs", "at_high").alias("at_high"))
        now = settle(moved.withColumn("tries", _tries("low", "high", *[F.col(c).cast("string") for c in ("k", "at_low", "at_high")])))
        discard(state)
        state = now
    return state.groupBy("_g").agg(F.avg("high").alias(out)).unionByName(none)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _first_tries(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Slopes about the median of pairs of a sample, near and very near; they only save rounds."""
    out = []
    for x, y in zip(xs, ys):
        x, y = (np.zeros(0) if v is None else np.asarray(v, dtype=np.float64) for v in (x, y))
        rng = np.random.default_rng(0)
        i, j = (rng.integers(0, max(1, len(x)), 20_000 if len(x) else 0) for _ in range(2))
        apart = x[i] != x[j]
        slopes = (y[i] - y[j])[apart] / (x[i] - x[j])[apart]
        if not len(slopes):
            out.append([0.0])
            continue
        low, middle, high = (float(q) for q in np.quantile(slopes, (0.48, 0.5, 0.52)))
        step = max(1.0, abs(middle))
        out.append(sorted({low, high, *(middle + d * step for d in (-1e-9, -1e-12, 0.0, 1e-12, 1e-9))}))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _tries(low: pd.Series, high: pd.Series, k: pd.Series, at_low: pd.Series, at_high: pd.Series) -> pd.Series:
    whole = lambda v: None if v is None else int(v)
    return pd.Series([tries_between(a, b, int(r), whole(c), whole(d)) for a, b, r, c, d in zip(low, high, k, at_low, at_high)])


def _counts(blocks: DataFrame, shape: DataFrame, tried: DataFrame) -> DataFrame:
    """(_g, s, pairs): the pairs of each group with a slope of at most s."""
    work = blocks.join(shape, "_g").join(tried.groupBy("_g").agg(F.sort_array(F.collect_list("s")).alias("slopes")), "_g")
    work = work.select("_g", "block", *[F.col(f"points.{c}").alias(c) for c in ("x", "y", "w")], F.col("sample.x").alias("sx"), F.col("sample.y").alias("sy"), "n_blocks", "slopes")
    group = work.schema["_g"]
    seen = settle(work.mapInArrow(_looked, T.StructType([group, *_SEEN.fields])))
    whole = F.col("range") < 0
    inside = seen.where(whole).select("_g", "s", F.col("inside").alias("pairs"))
    ranged = seen.where(~whole).groupBy("_g", "s", "range").agg(F.collect_list(F.struct("block", "z", "w")).alias("parts")).where(F.size("parts") > 1)
    counted = T.StructType([group, T.StructField("s", T.DoubleType()), T.StructField("pairs", T.LongType())])
    met = ranged.mapInArrow(_across, counted)
    # Histograms pass in the blocks' order; one running sum stays.
    named = seen.where(whole).select(F.xxhash64("_g", "s").alias("_h"), "_g", "s", "block", "w")
    apart = named.repartition("_h").sortWithinPartitions("_h", "_g", "s", "block").select("_g", "s", "w").mapInArrow(_between_ranges, counted)
    every = inside.unionByName(met).unionByName(apart)
    sums = settle(every.groupBy("_g", "s").agg(F.sum(F.col("pairs").cast("decimal(38,0)")).alias("pairs")))
    discard(seen)
    return sums


_SEEN = T.StructType([
    T.StructField("s", T.DoubleType()), T.StructField("block", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("inside", T.LongType()),
    T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("w", T.ArrayType(T.LongType()))])


def _values(column: pa.Array, row: int) -> np.ndarray:
    held = column[row].values
    return held.to_numpy(zero_copy_only=False) if held is not None else np.zeros(0)


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and slope: a row of range -1 with its own pairs and its weight in each range, and a row per range with what is there."""
    for batch in batches:
        for row in range(batch.num_rows):
            x, y, w, sx, sy, slopes = (_values(batch.column(c), row) for c in ("x", "y", "w", "sx", "sy", "slopes"))
            ranges = min(RANGES, max(2, batch.column("n_blocks")[row].as_py()))
            for s in slopes.tolist():
                z = _rest(x, y, s)
                edges = np.unique(np.quantile(_rest(sx, sy, s), np.arange(1, ranges) / ranges)) if len(sx) else np.zeros(0)
                value, at = np.unique(z, return_inverse=True)
                weight = np.zeros(len(value), dtype=np.int64)
                np.add.at(weight, at, w)
                place = np.searchsorted(edges, value, side="left")
                cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
                histogram = np.zeros(len(edges) + 1, dtype=np.int64)
                np.add.at(histogram, place, weight)
                count = len(cuts) + 1
                lists = lambda first, values, kind: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0, len(first)], len(first) + np.append(cuts[1:], len(value))]), pa.int32()), pa.array(np.concatenate([first, values]), kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_g").take(pa.array([row] * count)), pa.array([s] * count), batch.column("block").take(pa.array([row] * count)),
                     pa.array(np.concatenate([[-1], place[cuts]]), pa.int32()), pa.array([falling_pairs(x, z, w)] + [0] * (count - 1), pa.int64()),
                     lists(np.zeros(0), value, pa.float64()), lists(histogram, weight, pa.int64())], names=["_g", *_SEEN.names])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different blocks in one range."""
    for batch in batches:
        pairs = []
        for row in range(batch.num_rows):
            parts = batch.column("parts")[row].values
            z, w = (parts.field(c) for c in ("z", "w"))
            sizes = pc.list_value_length(z).to_numpy(zero_copy_only=False)
            block = np.repeat(parts.field("block").to_numpy(zero_copy_only=False), sizes)
            pairs.append(falling_pairs(block, z.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("s"), pa.array(pairs, pa.int64())], names=["_g", "s", "pairs"])


def _between_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of an earlier block in a higher range, of histograms that come group by group, slope by slope and block by block."""
    name, before = None, None
    for batch in batches:
        pairs = []
        groups, slopes, held = batch.column("_g").to_pylist(), batch.column("s").to_pylist(), batch.column("w")
        for row, now in enumerate(zip(map(repr, groups), slopes)):
            histogram = held[row].values.to_numpy(zero_copy_only=False)
            if now != name:
                name, before = now, np.zeros(len(histogram), dtype=np.int64)
            higher = before.sum() - np.cumsum(before)
            pairs.append(int(np.sum(histogram * higher)))
            before = before + histogram
        yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("s"), pa.array(pairs, pa.int64())], names=["_g", "s", "pairs"])
