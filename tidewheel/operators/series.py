"""Series on a frame grid: framing, levels, onsets, normalisation, jumps, passages, smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import constants as C
from tidewheel.constants import BLOCK
from tidewheel.functions import scalar as S
from tidewheel.operators.blocks import halo, islands, over_blocks, prefix, sliding_sum
from tidewheel.operators.joins import spread_index
from tidewheel.operators.quantiles import exact_percentiles
from tidewheel.session import settle


# ---- framing
def frame_grid(events: DataFrame, keys: Sequence[str], t: Column, value: Column, hop: float,
               frames: int | None = None, size: int = BLOCK) -> DataFrame:
    """Timestamped rows as a dense series: frame i is centred on i*hop.

    Returns keys, frame, n, value (sum), square (sum of squares). Empty frames are present with
    n = 0. `frames` fixes the length; left out, a series runs to its last row. Rows and spine
    meet in one aggregation, so the rows are combined before the only shuffle.
    """
    keys = list(keys)
    binned = events.select(*keys, F.floor(t / hop + 0.5).cast("bigint").alias("frame"), value.alias("_v"))
    binned = binned.where(F.col("frame") >= 0)
    if frames is None:
        extent = binned.groupBy(*keys).agg((F.max("frame") + 1).alias("_count"))
    else:
        binned = binned.where(F.col("frame") < frames)
        extent = binned.select(*keys).distinct().withColumn("_count", F.lit(frames).cast("bigint"))
    spine = spread_index(extent, keys, "_count", "frame", size).withColumn("_v", F.lit(None).cast("double"))
    return (binned.unionByName(spine).groupBy(*keys, "frame").agg(
        F.count("_v").alias("n"),
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum(F.col("_v") * F.col("_v")), F.lit(0.0)).alias("square")))


def level(frames: DataFrame, out: str = "rmsdb") -> DataFrame:
    """Level of each frame in dB from its mean square; an empty frame is at the floor."""
    mean_square = F.when(F.col("n") > 0, F.col("square") / F.col("n")).otherwise(0.0)
    return frames.withColumn(out, S.to_db(mean_square))


# ---- change
def rising(df: DataFrame, keys: Sequence[str], value: str, out: str = "flux", index: str = "frame",
           log_gain: float | None = None, size: int = BLOCK) -> DataFrame:
    """Rectified difference from the row before, 0 on the first; `log_gain` takes log1p(gain*x) first."""
    x = F.col(value) if log_gain is None else F.log1p(F.lit(log_gain) * F.col(value))
    return over_blocks(df.withColumn("_x", x), keys, index, {
        out: lambda w: F.greatest(F.col("_x") - F.coalesce(F.lag("_x").over(w), F.col("_x")), F.lit(0.0)),
    }, before=1, size=size).drop("_x")


def onset_strength(df: DataFrame, keys: Sequence[str], flux: str | None = None, out: str = "onset", index: str = "frame",
                   fps: int = C.FPS, level: str | None = None, size: int = BLOCK) -> DataFrame:
    """Flux over its centred half-second average, rectified, then a 3-frame box.

    The average always divides by its whole width, so it counts zeros past either end; an even
    width reaches one row further back than ahead. Given a `level` instead of a flux, the flux is
    its rise, taken in the same pass.
    """
    width = max(1, round(fps * 0.5))
    back, ahead = width // 2, (width - 1) // 2
    steps = {}
    if level is not None:
        flux = "_flux"
        steps[flux] = lambda w: F.greatest(
            F.col(level) - F.coalesce(F.lag(level).over(w), F.col(level)), F.lit(0.0))
    steps["_over"] = lambda w: F.greatest(
        F.col(flux) - F.sum(flux).over(w.rowsBetween(-back, ahead)) / width, F.lit(0.0))
    steps[out] = lambda w: F.sum("_over").over(w.rowsBetween(-1, 1)) / 3.0
    return over_blocks(df, keys, index, steps, before=back + 2, after=ahead + 1, size=size).drop("_over", "_flux")


def energy_jumps(df: DataFrame, keys: Sequence[str], value: str, index: str = "frame", z: float = 2.0,
                 size: int = BLOCK) -> DataFrame:
    """Rows whose step from the row before is at least `z` deviations above the series' mean step."""
    keys = list(keys)
    stepped = over_blocks(df, keys, index, {
        "_d": lambda w: F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value))}, before=1, size=size)
    stepped = settle(stepped)
    shape = stepped.groupBy(*keys).agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"),
                                       F.count("*").alias("_n"))
    score = (F.col("_d") - F.col("_m")) / F.when(F.col("_s") == 0, F.lit(1e-9)).otherwise(F.col("_s"))
    return (stepped.join(shape, keys).where(F.col("_n") >= 2).withColumn("z", score)
            .where(F.col("z") >= z).drop("_d", "_m", "_s", "_n"))


# ---- normalisation
def percentile_normalize(df: DataFrame, keys: Sequence[str], value: str, out: str, lo: float = C.NORMALISE_LOW,
                         hi: float = C.NORMALISE_HIGH, mask: Column | None = None,
                         zero_outside_mask: bool = False) -> DataFrame:
    """The `lo` percentile to 0 and the `hi` percentile to 1, clipped; a flat series is all 0.

    `mask` picks the rows that set the percentiles; with `zero_outside_mask` the others read 0.
    """
    keys = list(keys)
    ref = df if mask is None else df.where(mask)
    bounds = exact_percentiles(ref, keys, value, {"_a": lo, "_b": hi})
    span = F.col("_b") - F.col("_a")
    scaled = F.when(span > 1e-9, S.clamp((F.col(value) - F.col("_a")) / span)).otherwise(0.0)
    if mask is not None and zero_outside_mask:
        scaled = F.when(mask, scaled).otherwise(0.0)
    return df.join(bounds, keys, "left").withColumn(out, scaled).drop("_a", "_b")


def sounding_normalize(df: DataFrame, keys: Sequence[str], level_db: str, out: str) -> DataFrame:
    return percentile_normalize(df, keys, level_db, out, mask=F.col(level_db) > C.FLOOR_DB, zero_outside_mask=True)


def flux_normalize(df: DataFrame, keys: Sequence[str], value: str, out: str,
                   ceiling: float = C.FLUX_CEILING) -> DataFrame:
    """Flux over its 99.5th percentile, clipped at 1.5; all 0 when that percentile is not positive."""
    keys = list(keys)
    ref = exact_percentiles(df, keys, value, {"_ref": C.NORMALISE_HIGH})
    scaled = F.when(F.col("_ref") > 0, S.clamp(F.col(value) / F.col("_ref"), 0.0, ceiling)).otherwise(0.0)
    return df.join(ref, keys, "left").withColumn(out, scaled).drop("_ref")


def vocal_presence(df: DataFrame, keys: Sequence[str], mid_db: str, side_db: str, side_to_mid: str,
                   out: str = "voc") -> DataFrame:
    """Centre-over-sides contrast on 0..1; 0 in silence and for dual mono."""
    contrast = S.side_contrast(F.col(mid_db), F.col(side_db), F.col(side_to_mid))
    sounding = F.col(mid_db) > C.FLOOR_DB
    base = df.withColumn("_contrast", F.when(sounding, contrast))
    normal = percentile_normalize(base, keys, "_contrast", out, mask=F.col("_contrast").isNotNull(),
                                  zero_outside_mask=True)
    return normal.withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_contrast")


def relative_db(df: DataFrame, keys: Sequence[str], db: str, out: str, top_db: float = 80.0) -> DataFrame:
    """dB under the series' own peak."""
    peak = df.groupBy(*keys).agg(F.max(db).alias("_peak"))
    return df.join(peak, list(keys)).withColumn(out, S.db_below_peak(F.col(db), F.col("_peak"), top_db)).drop("_peak")


# ---- passages
def quiet_passages(df: DataFrame, keys: Sequence[str], db: str, t: str = "t", index: str = "frame",
                   threshold: float = -35.0, min_duration: float = 1.5, size: int = BLOCK) -> DataFrame:
    """Runs below `threshold` of at least `min_duration`.

    A run ends at the time of the first row after it, or at the last row's time when it reaches
    the end of the series.
    """
    keys = list(keys)
    marked = over_blocks(df, keys, index, {"_after": lambda w: F.lead(t).over(w)}, after=1, size=size)
    runs = islands(marked.withColumn("_quiet", F.col(db) < threshold), keys, index, "_quiet", "_run", size)
    found = runs.groupBy(*keys, "_run").agg(
        F.min(t).alias("start"), F.max(F.coalesce("_after", t)).alias("end"), F.avg(db).alias("mean_db"))
    return found.where(F.col("end") - F.col("start") >= min_duration).drop("_run")


def consecutive_ranges(df: DataFrame, keys: Sequence[str], number: str, size: int = BLOCK) -> DataFrame:
    """Whole numbers as [first, last] ranges of consecutive values."""
    keys = list(keys)
    present = df.select(*keys, number).distinct()
    flagged = over_blocks(present, keys, number, {
        "_start": lambda w: F.when(F.coalesce(F.lag(number).over(w) != F.col(number) - 1, F.lit(True)),
                                   F.col(number))}, before=1, size=size)
    runs = prefix(flagged, keys, {"_run": ("max", "_start")}, index=number, size=size)
    return runs.groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def loudest_window(df: DataFrame, keys: Sequence[str], db: str, width: int, index: str = "frame",
                   size: int = BLOCK) -> DataFrame:
    """First frame of the `width` frames with the most power (the earliest of equals); a series no
    longer than `width` starts at 0. Columns: start_frame, length (frames), power."""
    keys = list(keys)
    powered = df.select(*keys, index, S.db_to_power(F.col(db)).alias("_p"))
    ends = powered.groupBy(*keys).agg(F.max(index).alias("_last"))
    summed = sliding_sum(powered, keys, index, "_p", "_sum", 0, width - 1, size).join(ends, keys)
    full = (F.col(index) + width - 1 <= F.col("_last")) | ((F.col("_last") < width) & (F.col(index) == 0))
    best = F.struct(F.round("_sum", 9).alias("s"), (-F.col(index)).alias("f"))
    return summed.where(full).groupBy(*keys).agg(
        F.max(best).alias("_best"), F.max("_last").alias("_last")).select(
        *keys, (-F.col("_best.f")).alias("start_frame"),
        F.least(F.lit(width).cast("bigint"), F.col("_last") + 1).alias("length"), F.col("_best.s").alias("power"))


def snap_start_to_bar(df: DataFrame, start: Column, downbeat: Column, bar: Column, latest: Column, out: str) -> DataFrame:
    """The reachable bar line nearest a start time (bar lines run both ways from the downbeat)."""
    first = F.ceil((0.0 - downbeat) / bar - 1e-9)
    last = F.floor((latest - downbeat) / bar + 1e-9)
    k = F.least(F.greatest(F.rint((start - downbeat) / bar), first.cast("double")), last.cast("double"))
    snapped = F.when((bar > 0) & (first <= last), downbeat + k * bar).otherwise(start)
    return df.withColumn(out, F.least(F.greatest(F.lit(0.0), snapped), latest))


def near_event_max(frames: DataFrame, events: DataFrame, keys: Sequence[str], value: str, t: str, out: str,
                   fps: float = C.FPS, reach: int = 3, index: str = "frame", size: int = BLOCK) -> DataFrame:
    """The largest value within `reach` frames of each event's nearest frame."""
    keys = list(keys)
    near = over_blocks(frames.select(*keys, index, value), keys, index, {
        out: lambda w: F.greatest(F.max(value).over(w.rowsBetween(-reach, reach)), F.lit(0.0))},
        before=reach, after=reach, size=size).drop(value)
    ends = frames.groupBy(*keys).agg(F.max(index).alias("_end"))
    at = F.least(F.greatest(F.rint(F.col(t) * fps).cast("bigint"), F.lit(0).cast("bigint")), F.col("_end"))
    return events.join(ends, keys).withColumn(index, at).join(near, [*keys, index]).drop("_end", index)


def audible_span(df: DataFrame, keys: Sequence[str], db: str, index: str = "frame",
                 within: float = C.AUDIBLE_DB) -> DataFrame:
    """First and last frame within `within` dB of the series' loudest one."""
    keys = list(keys)
    peak = df.groupBy(*keys).agg(F.max(db).alias("_peak"))
    return df.join(peak, keys).where(F.col(db) > F.col("_peak") - within).groupBy(*keys).agg(
        F.min(index).alias("first_frame"), F.max(index).alias("last_frame"))


# ---- smoothing
def _memory(tau: float) -> tuple[int, int]:
    """(rows after which tau^k is below double precision, block size that keeps tau^-k in range)."""
    fall = -math.log(tau)
    return math.ceil(37.0 / fall), math.floor(600.0 / fall)


def exponential_smooth(df: DataFrame, keys: Sequence[str], value: str, out: str, tau: float = 0.55,
                       index: str = "frame") -> DataFrame:
    """x = tau*x_before + (1-tau)*v from x = 0, as a running sum in short blocks.

    Within a block the weights tau^(n-j) factor into tau^n * tau^-j; each block starts far enough
    back that what it leaves out is below double precision.
    """
    reach, size = _memory(tau)
    grow = F.pow(F.lit(tau), -(F.col(index) - F.col("_blk") * size).cast("double"))

    def smooth(w):
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return (1.0 - tau) * F.sum(F.col(value) * grow).over(w) / grow

    return over_blocks(df, keys, index, {out: smooth}, before=reach, size=size)


def auto_gain(df: DataFrame, keys: Sequence[str], value: str, out: str, decay: float = 0.9995,
              start: float = 1e-3, index: str = "frame", size: int = BLOCK) -> DataFrame:
    """value over a decaying running maximum m = max(m*decay, value) that starts at `start`.

    ln m at row n is n*ln(decay) plus the running maximum of ln(value) - j*ln(decay), a prefix fold.
    """
    ln_d = math.log(decay)
    logged = df.withColumn("_y", F.when(F.col(value) > 0, F.log(F.col(value)) - F.col(index) * ln_d))
    run = prefix(logged, keys, {"_m": ("max", "_y")}, index=index, size=size)
    initial = math.log(start) + ln_d
    peak = F.exp(F.greatest(F.col("_m"), F.lit(initial)) + F.col(index) * ln_d)
    return (run.withColumn(out + "_ref", peak).withColumn(out, S.clamp(F.col(value) / F.col(out + "_ref")))
            .drop("_y", "_m"))


def glide(df: DataFrame, keys: Sequence[str], target: str, out: str, rate: float, index: str = "frame") -> DataFrame:
    """v = v + (target - v)*rate from the first target: smoothing of the distance from it."""
    tau = 1.0 - rate
    reach, size = _memory(tau)
    grow = F.pow(F.lit(tau), -(F.col(index) - F.col("_blk") * size).cast("double"))

    w = Window.partitionBy(*keys, "_blk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    placed = halo(df, index, size, before=reach).withColumn("_from", F.first(target).over(w)).withColumn(
        "_away", (F.col(target) - F.col("_from")) * grow)
    level = F.col("_from") + rate * F.sum("_away").over(w) / grow
    return placed.withColumn(out, level).where("_own").drop("_blk", "_own", "_from", "_away")


def box_mean(samples: DataFrame, frames: DataFrame, keys: Sequence[str], t: str, value: str, out: str,
             width: float, fps: float, step: float = 0.02) -> DataFrame:
    """Mean of the interpolated series over +-width around each sample time, every `step`."""
    from tidewheel.operators.joins import sample_linear

    count = math.floor((2 * width + 1e-9) / step) + 1
    # Equal samples are read once and given back as often as they came.
    numbered = samples.groupBy(*samples.columns).agg(F.count("*").alias("_copies")).withColumn("_row", F.struct(*samples.columns, "_copies"))
    spread = numbered.select(*keys, "_row", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_k"),
                             F.col(t).alias("_t")).withColumn(
        "_pos", (F.col("_t") - width + F.col("_k") * step) * fps)
    read = sample_linear(spread, frames, keys, "_pos", value, "_v")
    means = read.groupBy("_row").agg(F.avg("_v").alias(out))
    return means.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_row._copies").cast("int")))).select("_row.*", out).drop("_copies")


# ---- vectors
def cosine_novelty(df: DataFrame, keys: Sequence[str], vector: str, order: str, out: str = "novelty",
                   root: bool = False, silence: float | None = 1e-6, size: int = BLOCK) -> DataFrame:
    """1 - cosine to the previous vector of the series, means removed; 0 on the first vector and
    next to silence (total under `silence` of the series' largest). `root` takes square roots of
    the shares first, as for chroma energies.

    Orders by a sparse whole number: the previous vector crosses blocks as one carried value.
    """
    keys = list(keys)
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    shape = F.transform(vector, lambda x: x.cast("double"))
    if root:
        shape = F.transform(vector, lambda x: F.sqrt(x.cast("double") / F.greatest(F.col("_total"), F.lit(1e-30))))
    base = df.withColumn("_total", total).withColumn("_raw", shape)
    mean = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x) / F.size("_raw")
    base = base.withColumn("_mean", mean).withColumn("_c", F.transform("_raw", lambda x: x - F.col("_mean")))
    base = base.withColumn("_norm", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, x: s + x * x)))
    linked = previous_row(base.withColumn("_pair", F.struct("_c", "_norm", "_total")), keys, order, "_pair", "_prev", size)
    if silence is not None:
        loudest = df.withColumn("_total", total).groupBy(*keys).agg(F.max("_total").alias("_top"))
        linked = linked.join(loudest, keys)
        floor = F.greatest(F.col("_top"), F.lit(1e-30)) * silence
        sounding = (F.col("_total") > floor) & (F.col("_prev._total") > floor)
    else:
        sounding = F.lit(True)
    dot = F.aggregate(F.zip_with("_c", "_prev._c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    cosine = dot / (F.greatest(F.col("_norm"), F.lit(1e-12)) * F.greatest(F.col("_prev._norm"), F.lit(1e-12)))
    value = F.when(F.col("_prev").isNotNull() & sounding, 1.0 - cosine).otherwise(0.0)
    return linked.select(*df.columns, value.alias(out))


def previous_row(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, size: int = BLOCK) -> DataFrame:
    """The value of the previous row in `order`, which may be sparse (whole numbers)."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    src = df.withColumn("_blk", F.floor(F.col(order) / size).cast("bigint"))
    local = src.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    lasts = src.groupBy(*keys, "_blk").agg(F.max_by(value, order).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy("_blk")
    carry = lasts.select(*keys, "_blk", F.lag("_last").over(wb).alias("_carry"))
    return local.join(carry, [*keys, "_blk"], "left").withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop("_blk", "_lag", "_first", "_carry")


# ---- legacy scales and rounding
def read_scales(df: DataFrame, keys: Sequence[str], value: str, rms: str, cent: str | None = None,
                index: str = "frame", head: int = 4000) -> DataFrame:
    """Levels as 0..1 whatever scale a series was stored in: a series whose first `head` rms values
    pass 1.5 is in bytes, a centroid that passes 1.5 otherwise is in Hz."""
    keys = list(keys)
    aggs = [F.max(F.when(F.col(index) < head, F.col(rms))).alias("_rms_top")]
    if cent is not None:
        aggs.append(F.max(cent).alias("_cent_top"))
    tops = df.groupBy(*keys).agg(*aggs)
    bytes_ = F.col("_rms_top") > 1.5
    scale = F.when(bytes_, F.lit(255.0)).otherwise(1.0)
    out = df.join(tops, keys).withColumn(value, S.clamp(F.col(value) / scale))
    if cent is not None:
        by_hz = F.when(bytes_, 255.0).when(F.col("_cent_top") > 1.5, C.CENTROID_SCALE_HZ).otherwise(1.0)
        out = out.withColumn(cent, S.clamp(F.col(cent) / by_hz))
    return out.drop("_rms_top", "_cent_top")


def stride_rows(df: DataFrame, keys: Sequence[str], width: int, index: str = "frame") -> DataFrame:
    """Every k-th row, k = rows // width (at least 1): a series thinned for plotting."""
    keys = list(keys)
    sized = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") / width).cast("bigint"))
    return df.join(sized, keys).where(F.col(index) % step == 0).drop("_n")


def held_levels(times: DataFrame, frames: DataFrame, keys: Sequence[str], t: str, value: str, out: str,
                fps: float, rate: float = 12.0) -> DataFrame:
    """A level read at time held to `rate` a second."""
    from tidewheel.operators.joins import sample_linear

    placed = times.withColumn("_pos", S.held_time(F.col(t), rate) * fps)
    return sample_linear(placed, frames, keys, "_pos", value, out).drop("_pos")

