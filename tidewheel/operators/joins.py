"""Lookups between two ordered tables: as-of, nearest, interval, sampled, assigned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.constants import BLOCK
from tidewheel.operators.blocks import neighbour, number_rows, over_blocks, prefix
from tidewheel.session import settle


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    take: Sequence[str],
    tolerance: float = 1e-6,
    bucket: float = 3600.0,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Each left row with the `take` columns of the last right row at or before it
    (`forward`: the first at or after), NULL where there is none.

    A right row up to `tolerance` past the left time still counts as at it; `strict` excludes
    equal times instead. Both tables are merged on (keys, time bucket) and the carry crosses
    buckets by one summary row each, so no pair of rows is ever enumerated.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    shift = tolerance if forward else -tolerance
    right_first = 1 if strict else 0
    if forward:
        right_first = 1 - right_first
    rights = right.select(*keys, (F.col(right_t).cast("double") + shift).alias("_t"),
                          F.lit(2 * right_first).alias("_tag"), payload.alias("_right"))
    lefts = left.select(*keys, F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_tag"),
                        F.struct(*left.columns).alias("_left"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    carried = prefix(both, keys, {"_hit": ("last", "_right")}, order=["_t", "_tag"],
                     block=F.floor(F.col("_t") / bucket).cast("bigint"), reverse=forward)
    return carried.where(F.col("_left").isNotNull()).select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in take])


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
                 out: str = "nearest_t", bucket: float = 3600.0) -> DataFrame:
    """Each left row with the nearest right time (the earlier of two equally near) and the gap.

    One merge serves both directions: a right row sorts before the left rows at its time for the
    backward carry, and a second copy sorts after them for the forward one.
    """
    keys = list(keys)
    at = F.col(right_t).cast("double")
    none = F.lit(None).cast("double")
    rights = right.select(*keys, at.alias("_t"), F.explode(F.array(F.lit(0), F.lit(2))).alias("_tag"))
    rights = rights.select(*keys, "_t", "_tag", F.when(F.col("_tag") == 0, F.col("_t")).alias("_before"),
                           F.when(F.col("_tag") == 2, F.col("_t")).alias("_after"))
    lefts = left.select(*keys, F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_tag"), none.alias("_before"),
                        none.alias("_after"), F.struct(*left.columns).alias("_left"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    found = prefix(both, keys, {"_b": ("last", "_before"), "_a": ("last", "_after", "reverse")}, order=["_t", "_tag"],
                   block=F.floor(F.col("_t") / bucket).cast("bigint")).where(F.col("_left").isNotNull())
    ahead, back = F.col("_a") - F.col("_t"), F.col("_t") - F.col("_b")
    pick = F.when(F.col("_b").isNull() | (ahead < back), F.col("_a")).otherwise(F.col("_b"))
    return found.withColumn(out, pick).select("_left.*", out, F.abs(F.col("_t") - F.col(out)).alias("gap"))


def rank_at(probes: DataFrame, events: DataFrame, keys: Sequence[str], probe_t: str, event_t: str, out: str,
            tolerance: float = 1e-6, inclusive: bool = True, bucket: float = 3600.0) -> DataFrame:
    """How many events of the key lie at or before each probe (`inclusive`, an event up to
    `tolerance` past it counts) or strictly before it (one within `tolerance` does not)."""
    keys = list(keys)
    shift = tolerance if inclusive else -tolerance
    marks = events.select(*keys, F.col(event_t).cast("double").alias("_t"), F.lit(0 if inclusive else 2).alias("_tag"),
                          F.lit(1).alias("_one"))
    asked = probes.select(*keys, (F.col(probe_t).cast("double") + shift).alias("_t"), F.lit(1).alias("_tag"),
                          F.struct(*probes.columns).alias("_left"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    return prefix(both, keys, {out: ("count", "_one")}, order=["_t", "_tag"],
                  block=F.floor(F.col("_t") / bucket).cast("bigint")).where(
        F.col("_left").isNotNull()).select("_left.*", out)


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str,
                  width: float, how: str = "inner", closed_end: bool = False) -> DataFrame:
    """Points inside half-open [start, end) intervals, joined on the buckets the interval covers.

    `width` is the bucket width: about the typical interval's length. A hot bucket is an
    ordinary hot join key, which adaptive skew handling splits.
    """
    keys = list(keys)
    lo, hi = F.col(f"_iv.{start}").cast("double"), F.col(f"_iv.{end}").cast("double")
    spread = intervals.select(*keys, F.struct(*[c for c in intervals.columns if c not in keys]).alias("_iv"))
    spread = spread.withColumn("_bucket", F.explode(F.sequence(
        F.floor(lo / width).cast("bigint"), F.floor(hi / width).cast("bigint"))))
    placed = points.withColumn("_bucket", F.floor(F.col(t).cast("double") / width).cast("bigint"))
    at = F.col(t).cast("double")
    inside = (at >= lo) & ((at <= hi) if closed_end else (at < hi))
    condition = inside
    for k in [*keys, "_bucket"]:
        condition = condition & (placed[k] == spread[k])
    joined = placed.join(spread, condition, how)
    cols = [placed[c] for c in points.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*cols)
    return joined.select(*cols, *[F.col(f"_iv.{c}").alias(c) for c in intervals.columns
                                  if c not in keys and c not in points.columns])


def sample_linear(
    samples: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    out: str,
    index: str = "frame",
    outside: str = "hold",
    fill: float = 0.0,
    size: int = BLOCK,
) -> DataFrame:
    """Read `value` at fractional frame `position`s, linear between frames.

    Past either end the value holds ("hold") or becomes `fill` ("fill").
    """
    keys = list(keys)
    ahead = neighbour(frames.select(*keys, index, value), keys, index, {"_next": (value, 1)}, size)
    ends = frames.groupBy(*keys).agg(F.max(index).alias("_end"))
    at = F.col(position).cast("double")
    placed = samples.join(ends, keys, "left").withColumn(
        "_f", F.floor(F.least(F.greatest(at, F.lit(0.0)), F.col("_end").cast("double"))).cast("bigint"))
    hit = placed.join(ahead.select(*keys, F.col(index).alias("_f"), F.col(value).alias("_v"), "_next"),
                      [*keys, "_f"], "left")
    part = F.least(F.greatest(at, F.lit(0.0)), F.col("_end").cast("double")) - F.col("_f")
    read = F.col("_v") + (F.coalesce("_next", "_v") - F.col("_v")) * part
    if outside == "fill":
        read = F.when((at < 0) | (at > F.col("_end")), F.lit(fill)).otherwise(read)
    return hit.select(*[F.col(c) for c in samples.columns], read.alias(out))


def keyframe_values(times: DataFrame, points: DataFrame, keys: Sequence[str], t: str, key_t: str, key_v: str,
                    out: str, ease: bool = True, bucket: float = 3600.0, order: str | None = None) -> DataFrame:
    """A value over time from breakpoints: eased between the two around `t`, held at both ends.

    Breakpoints at one time make a jump: the last of them in `order` holds from there on, the
    first is what the ramp before it reaches.
    """
    keys = list(keys)
    rank = F.lit(0) if order is None else F.col(order)
    marks = points.select(*keys, F.col(key_t).cast("double").alias("_t"), F.lit(0).alias("_tag"), rank.cast("double").alias("_ord"),
                          F.struct(F.col(key_t).cast("double").alias("t"), F.col(key_v).cast("double").alias("v")).alias("_key"))
    asked = times.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_tag"), F.lit(0.0).alias("_ord"),
                         F.struct(*times.columns).alias("_left"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    hit = prefix(both, keys, {"_p": ("last", "_key"), "_n": ("last", "_key", "reverse")}, order=["_t", "_tag", "_ord"],
                 block=F.floor(F.col("_t") / bucket).cast("bigint")).where(F.col("_left").isNotNull())
    t0, v0, t1, v1 = F.col("_p.t"), F.col("_p.v"), F.col("_n.t"), F.col("_n.v")
    u = F.least(F.greatest((F.col("_t") - t0) / (t1 - t0), F.lit(0.0)), F.lit(1.0))
    u = u * u * (3.0 - 2.0 * u) if ease else u
    value = F.when(t0.isNull(), v1).when(t1.isNull(), v0).otherwise(v0 + (v1 - v0) * u)
    return hit.select("_left.*", value.alias(out))


def hash_order(seed: Column, *parts: Column) -> Column:
    """A repeatable shuffle key in [0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(seed, *parts), 11)).cast("double") / F.lit(float(1 << 53))


def round_robin(slots: DataFrame, pool: DataFrame, keys: Sequence[str], slot: str, item: str, out: str,
                seed: Column | None = None, shuffle: Column | None = None, buckets: int = 64) -> DataFrame:
    """Slot i of a key takes item i mod n of that key's pool, in seeded hash order (or by any
    `shuffle` column in [0, 1)).

    The pool is numbered in hash-range buckets, so a pool holding most items is still
    numbered in parallel.
    """
    keys = list(keys)
    key = shuffle if shuffle is not None else hash_order(seed if seed is not None else F.lit(0), F.col(item))
    ordered = pool.withColumn("_h", key)
    numbered = number_rows(ordered, keys, ["_h", item], F.floor(F.col("_h") * buckets).cast("bigint"), "_rank")
    sized = numbered.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = slots.join(sized, keys).withColumn("_rank", F.pmod(F.col(slot), F.col("_n")) + 1)
    return (placed.join(numbered.select(*keys, "_rank", F.col(item).alias(out)), [*keys, "_rank"])
            .drop("_rank", "_n"))


def lined_up(frames: DataFrame, lags: DataFrame, keys: Sequence[str], value: str, index: str = "frame",
             length: str = "length", lag: str = "lag", size: int = BLOCK) -> DataFrame:
    """Move a series `lag` frames later onto a reference of `length` frames: silence (0) where it
    has nothing, the tail trimmed. `lags` has one row per series."""
    keys = list(keys)
    moved = (frames.join(lags.select(*keys, lag, length), keys)
             .select(*keys, (F.col(index) + F.col(lag)).cast("bigint").alias(index), value, length)
             .where((F.col(index) >= 0) & (F.col(index) < F.col(length))).drop(length))
    spine = spread_index(lags.select(*keys, F.col(length).alias("_count")), keys, "_count", index, size)
    return (moved.unionByName(spine.withColumn(value, F.lit(0.0)))
            .groupBy(*keys, index).agg(F.sum(value).alias(value)))


def spread_index(extent: DataFrame, keys: Sequence[str], count: str, index: str = "frame",
                 size: int = BLOCK) -> DataFrame:
    """Rows 0..count-1 per key, generated block by block."""
    blocks = extent.where(F.col(count) > 0).select(
        *keys, F.col(count).alias("_count"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / size).cast("bigint"))).alias("_b"))
    return blocks.select(*keys, F.explode(F.sequence(
        F.col("_b") * size, F.least(F.col("_b") * size + size, F.col("_count")) - 1)).alias(index))


def full_span(pairs: Sequence[DataFrame], keys: Sequence[str], names: Sequence[str], fill: float | None,
              index: str = "frame", value: str = "value") -> DataFrame:
    """Several series on one index: one row per index any of them has, missing values `fill`."""
    tagged = None
    for name, df in zip(names, pairs):
        part = df.select(*keys, index, F.lit(name).alias("_side"), F.col(value).alias("_v"))
        tagged = part if tagged is None else tagged.unionByName(part)
    cols = [F.max(F.when(F.col("_side") == n, F.col("_v"))).alias(n) for n in names]
    out = tagged.groupBy(*keys, index).agg(*cols)
    return out if fill is None else out.fillna(fill, subset=list(names))


def clip_intervals(cuts: DataFrame, keys: Sequence[str], start: str, end: str, lo: Column, hi: Column,
                   fps: int, block: Column | None = None) -> DataFrame:
    """The part of each interval inside [lo, hi] (both on the frame grid first), rebased to 0 and
    renumbered; slivers under one frame are dropped."""
    lo, hi = F.rint(lo * fps) / fps, F.rint(hi * fps) / fps
    s, e = F.greatest(F.col(start), lo), F.least(F.col(end), hi)
    kept = (cuts.withColumn("_s", s - lo).withColumn("_e", e - lo)
            .where(e - s >= 1.0 / fps - 1e-9).drop(start, end)
            .withColumnRenamed("_s", start).withColumnRenamed("_e", end))
    block = block if block is not None else F.floor(F.col(start) / 3600.0).cast("bigint")
    return number_rows(kept, keys, [start, end], block, "_n").withColumn("idx", F.col("_n") - 1).drop("_n")


def best_match(items: DataFrame, profiles: DataFrame, keys: Sequence[str], score, name: str, order: str,
               out: str = "best", score_out: str = "score") -> DataFrame:
    """Every item with its highest-scoring profile of the same key; the first in `order` wins ties.

    A key's profiles are one short document (its looks), so they travel as one array and are
    folded inside the item's row: items are never multiplied by profiles. `score(profile)` maps
    the profile struct to a column and may use the item's columns.
    """
    keys = list(keys)
    fields = [c for c in profiles.columns if c not in keys]
    listed = profiles.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col(order).alias("_ord"), *[F.col(c) for c in fields]))).alias("_profiles"))
    scored = F.transform("_profiles", lambda p: F.struct(
        score(p).alias("s"), (-p["_ord"]).alias("o"), p[name].alias("n")))
    joined = items.join(listed, keys, "left").withColumn("_best", F.array_max(scored))
    return joined.select(*items.columns, F.col("_best.n").alias(out), F.col("_best.s").alias(score_out))


def range_count(df: DataFrame, keys: Sequence[str], value: str, radius: float, weight: str, out: str) -> DataFrame:
    """Total weight within `radius` of each value: the running weight up to its far end less that before its near end.

    Each end is looked up among the values in one merged order, which is dealt out by ranges of it; the running weights cross
    ranges by one summary row each. So neither a key nor a stretch of close values is ever one task.
    """
    keys = list(keys)
    at, w = F.col(value).cast("double"), F.col(weight)
    zero = F.lit(0).cast(df.schema[weight].dataType)
    row = F.struct(*df.columns)
    # At equal places a near end stands before the values, a far end after them.
    marks = F.array(F.struct((at - radius).alias("_t"), F.lit(0).alias("_tag"), zero.alias("_w"), row.alias("_row")),
                    F.struct(at.alias("_t"), F.lit(1).alias("_tag"), w.alias("_w"), F.lit(None).cast(df.select(row).schema[0].dataType).alias("_row")),
                    F.struct((at + radius).alias("_t"), F.lit(2).alias("_tag"), zero.alias("_w"), row.alias("_row")))
    merged = df.select(*keys, F.explode(marks).alias("_m")).select(*keys, "_m.*")
    ranged = settle(merged.repartitionByRange(*keys, "_t", "_tag").withColumn("_range", F.spark_partition_id()))
    ran = prefix(ranged, keys, {"_sum": ("sum", "_w")}, order=["_t", "_tag"], block=F.col("_range")).where("_tag <> 1")
    ends = ran.groupBy("_row").agg(F.sum(F.when(F.col("_tag") == 2, F.col("_sum")).otherwise(-F.col("_sum"))).alias(out))
    return ends.select("_row.*", out)


def changes(df: DataFrame, keys: Sequence[str], index: str, cols: Sequence[str], size: int = BLOCK) -> DataFrame:
    """The rows whose `cols` differ from the row before (the first row of a series included)."""
    current = F.struct(*cols)
    return over_blocks(df.withColumn("_now", current), keys, index,
                       {"_before": lambda w: F.lag("_now").over(w)}, before=1, size=size).where(
        ~F.col("_now").eqNullSafe(F.col("_before"))).drop("_now", "_before")
