"""Summaries of series, sections, runs and groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import constants as C
from tidewheel.functions import scalar as S
from tidewheel.operators.blocks import join_keys
from tidewheel.operators.joins import interval_join, range_count
from tidewheel.operators.quantiles import exact_percentiles
from tidewheel.session import settle


def section_loudness(frames: DataFrame, sections: DataFrame, keys: Sequence[str], t: str, db: str,
                     width: float) -> DataFrame:
    """Mean level of each section on the series' own 0..1 range; 0.5 for a section with no frames."""
    keys = list(keys)
    ranges = frames.groupBy(*keys).agg(F.min(db).alias("_lo"), F.max(db).alias("_hi"))
    ids = [c for c in sections.columns if c not in keys]
    means = interval_join(frames, sections, keys, t, "start", "end", width).groupBy(*keys, *ids).agg(
        F.avg(db).alias("_mean"))
    span = F.col("_hi") - F.col("_lo")
    loud = (F.col("_mean") - F.col("_lo")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return (sections.join(means, [*keys, *ids], "left").join(ranges, keys, "left")
            .withColumn("loudness", F.coalesce(loud, F.lit(0.5))).drop("_mean", "_lo", "_hi"))


def section_distribution(df: DataFrame, keys: Sequence[str], value: str, step: float | None = 0.05) -> DataFrame:
    """Mean, nearest-rank 95th percentile and maximum per group, rounded to `step`."""
    keys = list(keys)
    top = exact_percentiles(df, keys, value, {"p95": 0.95}, kind="nearest")
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max")).join(top, keys)
    if step is None:
        return out.select(*keys, "mean", "p95", "max")
    return out.select(*keys, *[(F.floor(F.col(c) / step + 0.5) * step).alias(c) for c in ("mean", "p95", "max")])


def tile_means(frames: DataFrame, keys: Sequence[str], value: str, tiles: int, index: str = "frame") -> DataFrame:
    """Means of equal-count tiles of a series put on its own 0..1 range; tile k starts at
    row floor(rows*k/tiles), and an empty tile is 0."""
    keys = list(keys)
    sized = frames.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # The tile of row i: the largest k with floor(n*k/tiles) <= i.
    tile = F.floor(((F.col(index) + 1) * tiles - 1) / F.col("_n")).cast("bigint")
    span = F.col("_hi") - F.col("_lo")
    norm = (F.col(value) - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span)
    filled = frames.join(sized, keys).groupBy(*keys, tile.alias("tile")).agg(F.avg(norm).alias("level"))
    every = sized.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("tile"))
    return every.join(filled, [*keys, "tile"], "left").fillna(0.0, subset=["level"])


def beat_of_bar_evidence(beats: DataFrame, keys: Sequence[str], features: Sequence[str], per_bar: int = 4,
                         idx: str = "idx", block_bars: int = C.DOWNBEAT_BLOCK_BARS) -> DataFrame:
    """Which beat opens the bar: winner, runner_up (beat positions) and confidence per series.

    Each feature is centred within its bar and divided by its mean absolute size over all beats;
    positions are weighed like a t-test over the whole bars; confidence is the share of
    `block_bars`-bar blocks whose own best position is the winner by more than 0.05.
    """
    keys = list(keys)
    sizes = beats.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(F.abs(F.col(f))).alias(f"_s_{f}") for f in features])
    placed = (beats.join(sizes, keys).withColumn("_bar", F.floor(F.col(idx) / per_bar).cast("bigint"))
              .withColumn("_pos", (F.col(idx) % per_bar).cast("int"))
              .withColumn("_bars", F.floor(F.col("_n") / per_bar).cast("bigint")).where(F.col("_bar") < F.col("_bars")))
    in_bar = Window.partitionBy(*keys, "_bar")
    evidence = F.lit(0.0)
    for f in features:
        part = (F.col(f) - F.avg(f).over(in_bar)) / F.col(f"_s_{f}")
        evidence = evidence + F.when(F.col(f"_s_{f}") > 1e-12, part).otherwise(0.0)
    scored = placed.select(*keys, "_bar", "_pos", "_bars", evidence.alias("_e"))
    by_pos = scored.groupBy(*keys, "_pos").agg(F.avg("_e").alias("_m"), F.stddev_samp("_e").alias("_sd"),
                                               F.max("_bars").alias("_bars"))
    t = F.when(F.col("_bars") >= 2,
               F.col("_m") / F.greatest(F.col("_sd") / F.sqrt("_bars"), F.lit(1e-3))).otherwise(F.col("_m"))
    # The few positions of a bar, best first; equal scores keep the earlier position first.
    order = F.sort_array(F.collect_list(F.struct(F.round(t, 9).alias("t"), (-F.col("_pos")).alias("p"))), asc=False)
    ranked = by_pos.groupBy(*keys).agg(order.alias("_o"), F.max("_bars").alias("bars")).select(
        *keys, "bars", (-F.col("_o")[0]["p"]).alias("winner"), (-F.col("_o")[1]["p"]).alias("runner_up"))
    block_pos = scored.groupBy(*keys, F.floor(F.col("_bar") / block_bars).alias("_b"), "_pos").agg(F.avg("_e").alias("_m"))
    blocks = block_pos.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(
        F.struct(F.round("_m", 9).alias("m"), (-F.col("_pos")).alias("p"))), asc=False).alias("_o"))
    votes = blocks.join(ranked, keys).groupBy(*keys).agg(F.avg(F.when(
        (F.col("_o")[0]["m"] - F.col("_o")[1]["m"] > 0.05) & (-F.col("_o")[0]["p"] == F.col("winner")), 1.0)
        .otherwise(0.0)).alias("confidence"))
    known = ranked.join(votes, keys)
    return sizes.select(*keys).join(known, keys, "left").select(
        *keys, F.coalesce("winner", F.lit(0)).alias("winner"), "runner_up",
        F.round(F.coalesce("confidence", F.lit(0.0)), 2).alias("confidence"))


def pearson(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str = "r", flat: float = 1e-6,
            when_flat: float | None = None) -> DataFrame:
    """Pearson r per group; `when_flat` (default NULL) where either side barely moves."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    agg = df.where(both).groupBy(*keys).agg(
        safe_corr(x, y).alias("_r"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"), F.count("*").alias("_n"))
    ok = (F.col("_n") >= 2) & (F.col("_sx") >= flat) & (F.col("_sy") >= flat)
    return agg.select(*keys, F.when(ok, F.col("_r")).otherwise(F.lit(when_flat).cast("double")).alias(out))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r as an aggregate; NULL when either side does not move."""
    return F.covar_pop(a, b) / (F.nullif(F.stddev_pop(a), F.lit(0.0)) * F.nullif(F.stddev_pop(b), F.lit(0.0)))


def majority(df: DataFrame, keys: Sequence[str], value: str, member: str, radius: float = C.AGREE_S) -> DataFrame:
    """The value more than half of a group's members share within `radius`.

    Members come back with `agreed` (the median of those sharing it; NULL without a majority) and
    `outlier`. Equal values are counted first, so the sliding count runs over distinct values.
    """
    keys = list(keys)
    distinct = settle(df.groupBy(*keys, value).agg(F.count("*").alias("_w")))
    near = range_count(distinct, keys, value, radius, "_w", "_near")
    centre = near.groupBy(*keys).agg(F.max(F.struct("_near", F.col(value).alias("_c"))).alias("_best"),
                                     F.sum("_w").alias("_n"))
    placed = join_keys(df, centre, keys).withColumn("_in", F.abs(F.col(value) - F.col("_best._c")) <= radius)
    middle = exact_percentiles(placed.where("_in"), keys, value, {"_agreed": 0.5})
    wins = 2 * F.col("_best._near") > F.col("_n")
    return join_keys(placed, middle, keys, "left").select(
        *keys, member, value, F.when(wins, F.col("_agreed")).alias("agreed"), (~(wins & F.col("_in"))).alias("outlier"))


def weighted_level(df: DataFrame, keys: Sequence[str], side: str, mid: str, out: str = "side_to_mid_db") -> DataFrame:
    """Side over mid across a whole series, in dB, from summed power."""
    ratio = F.greatest(F.sum(side), F.lit(1e-30)) / F.greatest(F.sum(mid), F.lit(1e-30))
    return df.groupBy(*keys).agg((10.0 * F.log10(ratio)).alias(out))


def metric_medians(runs: DataFrame, keys: Sequence[str], run: str, metrics: str) -> DataFrame:
    """Median of every numeric metric all runs of a case share. `metrics` is a map column."""
    keys = list(keys)
    counted = runs.groupBy(*keys).agg(F.countDistinct(run).alias("_runs"))
    long = runs.select(*keys, run, F.explode(metrics).alias("metric", "_value"))
    shared = long.groupBy(*keys, "metric").agg(F.countDistinct(F.when(F.col("_value").isNotNull(), F.col(run))).alias("_have"))
    middle = exact_percentiles(long, [*keys, "metric"], "_value", {"median": 0.5})
    return (middle.join(shared, [*keys, "metric"]).join(counted, keys).where(F.col("_have") == F.col("_runs"))
            .select(*keys, "metric", F.round("median", 4).alias("median")))


def ordered_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column]) -> DataFrame:
    """Rows and sums per key, added in `order`: (keys, calls, sums). The last digits of a sum of doubles depend on the order they are
    added in, and with them which way a sum halfway between two rounded values goes; in a fixed order it is the same in every run.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.select(*keys, F.struct(F.count(F.lit(1)).over(w).alias("calls"), *[F.sum(c).over(w).alias(n) for n, c in sums.items()]).alias("_s"))
    return running.groupBy(*keys).agg(F.max_by("_s", "_s.calls").alias("_s")).select(*keys, "_s.*")


def profile_summary(calls: DataFrame, keys: Sequence[str], kind: str, ms: str, order: str, unnamed: str | None = None) -> DataFrame:
    """Calls and total ms by kind, added in `order`, with the kind's rank by time.

    Calls without a kind count as `unnamed`; without that they are a kind of their own, ranked last among equals. Calls without ms count,
    but add nothing; a kind of only such calls has no total and comes after the others.
    """
    keys = list(keys)
    named = calls if unnamed is None else calls.withColumn(kind, F.coalesce(F.col(kind), F.lit(unnamed)))
    out = ordered_sums(named, [*keys, kind], order, {"ms": F.col(ms)}).withColumn("ms", S.round_places(F.col("ms"), 1))
    w = Window.partitionBy(*keys).orderBy(F.col("ms").desc_nulls_last(), F.col(kind).asc_nulls_last())
    return out.withColumn("place", F.row_number().over(w))


def knee(df: DataFrame, keys: Sequence[str], x: str, metric: str, share: float = 0.95) -> DataFrame:
    """The smallest x whose metric is within `share` of the group's best."""
    keys = list(keys)
    best = df.groupBy(*keys).agg(F.max(metric).alias("best"))
    return df.join(best, keys).groupBy(*keys).agg(
        F.min(F.when(F.col(metric) >= share * F.col("best"), F.col(x))).alias("knee"), F.max("best").alias("best"))


def pitch_mask(pitch: Column) -> Column:
    """Pitch classes as a 12-bit set, to be combined with bit_or."""
    return F.pow(F.lit(2.0), F.pmod(pitch, F.lit(12)).cast("double")).cast("int")


def pitch_class_sets(df: DataFrame, keys: Sequence[str], pitch: str, out: str = "mask") -> DataFrame:
    return df.groupBy(*keys).agg(F.bit_or(pitch_mask(F.col(pitch))).alias(out))


def mood_line(stations: DataFrame, keys: Sequence[str], order: str, description: str, out: str = "mood") -> DataFrame:
    """First clause of the first three non-empty descriptions, lower case, comma separated.

    Only the three earliest rows per group are kept while aggregating.
    """
    keys = list(keys)
    clause = F.trim(F.split(F.split(F.col(description), ",")[0], " -- ")[0])
    clause = F.lower(F.regexp_replace(clause, r"^[. ]+|[. ]+$", ""))
    kept = top_k(stations.where(F.length(F.col(description)) > 0), keys, [F.col(order).asc()], 3)
    listed = kept.withColumn("_c", clause).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_c").alias("c")))).alias("_l"))
    return listed.select(*keys, F.array_join(F.col("_l.c"), ", ").alias(out))


def delivery_summary(artifacts: DataFrame, keys: Sequence[str], peak: str, lufs: str) -> DataFrame:
    """File count, worst peak and mean level of each run's measured files; absent stays NULL."""
    return artifacts.groupBy(*keys).agg(
        F.count("*").alias("files"), F.max(peak).alias("true_peak_max"), F.round(F.avg(lufs), 2).alias("lufs_mean"))


def profile_split(profile: DataFrame, keys: Sequence[str], kind: str, calls: str, ms: str,
                  order: str, codec: str = "aac") -> DataFrame:
    """A profile's encoding and measuring shares, told apart by the tokens of its kind; ms are added in `order`."""
    tokens = F.split(F.col(kind), r"\|")
    encode = F.array_contains(tokens, f"a={codec}")
    sums = ordered_sums(profile, keys, order, {
        "_n": F.when(encode, F.col(calls)), "_e": F.when(encode, F.col(ms)), "_m": F.when(F.array_contains(tokens, "null"), F.col(ms))})
    total = lambda c: S.round_places(F.coalesce(F.col(c), F.lit(0.0)), 1)
    return sums.select(*keys, F.coalesce("_n", F.lit(0)).alias("audio_encodes"), total("_e").alias("audio_encode_ms"), total("_m").alias("measure_ms"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt: int = 32) -> DataFrame:
    """The first k rows per group. Each of `salt` slices of a group keeps its own k first, so a
    group holding most rows is ranked in parallel and only salt*k of its rows meet."""
    sliced = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = sliced.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k).drop("_salt", "_r")
