"""Aligning and comparing two versions of a series.

A pair is a table (keys, frame, old, new): one row per frame either version has, NULL where one
has none. Lag searches never join frames with frames: each block of the pair correlates its own
frames with its neighbourhood in one array step and emits per-lag sums, which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel import constants as C
from tidewheel.constants import BLOCK
from tidewheel.functions import kernels as K
from tidewheel.functions import scalar as S
from tidewheel.operators.aggregates import safe_corr
from tidewheel.operators.blocks import over_blocks, pack
from tidewheel.operators.joins import full_span, sample_linear, spread_index
from tidewheel.operators.quantiles import exact_percentiles
from tidewheel.operators.slopes import theil_sen
from tidewheel.session import arrow_batches, settle

_MOMENTS = ("n", "sa", "sb", "saa", "sbb", "sab")
def pair_up(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str = "value",
            index: str = "frame") -> DataFrame:
    """Two versions on one index as (keys, frame, old, new)."""
    return full_span([old, new], keys, ["old", "new"], None, index, value)


# ---- lag search
def lag_sums(pairs: DataFrame, keys: Sequence[str], lo: int, hi: int, a: str = "old", b: str = "new",
             index: str = "frame", size: int = BLOCK) -> DataFrame:
    """Moments of a[i] against b[i + lag] for every lag in [lo, hi]: n, sa, sb, saa, sbb, sab."""
    keys = list(keys)
    before, after = max(0, -lo), max(0, hi)
    size = max(size, 2 * (before + after + 1))
    lags = hi - lo + 1

    def moments(batches):
        """One row for each series of a batch: its blocks meet in the spectra, so there is one inverse transform."""
        for batch in batches:
            series: dict[str, list[int]] = {}
            for row, key in enumerate(batch.select(keys).to_pylist()):
                series.setdefault(repr(key), []).append(row)
            blk, index_, x, y = (batch.column(c) for c in ("_blk", index, a, b))
            found = []
            for rows in series.values():
                pieces = []
                for row in rows:
                    at = index_[row].values.to_numpy(zero_copy_only=False)
                    start = blk[row].as_py() * size
                    own = max(1, min(size, int(at[-1]) + 1 - start))
                    left, right = (v[row].values.to_numpy(zero_copy_only=False) for v in (x, y))
                    pieces.append((K.dense(at, left, start, own), K.dense(at, right, start + lo, own + hi - lo)))
                found.append(K.lag_moments(pieces, lags))
            if found:
                head = batch.select(keys).take(pa.array([rows[0] for rows in series.values()]))
                columns = [pa.array([m[i] for m in found], pa.list_(pa.float64())) for i in range(len(_MOMENTS))]
                yield pa.RecordBatch.from_arrays([*head.columns, *columns], names=[*keys, *(f"_{m}" for m in _MOMENTS)])

    values = [a] if a == b else [a, b]
    blocks = pack(pairs.withColumns({v: F.col(v).cast("double") for v in values}), keys, index, values, size, before, after)
    schema = T.StructType([*blocks.select(*keys).schema.fields, *[T.StructField(f"_{m}", T.ArrayType(T.DoubleType())) for m in _MOMENTS]])
    summed = blocks.mapInArrow(moments, schema)
    rows = summed.select(*keys, F.posexplode(F.arrays_zip(*[f"_{m}" for m in _MOMENTS])).alias("_k", "_m"))
    return rows.groupBy(*keys, (F.col("_k") + lo).cast("int").alias("lag")).agg(*[F.sum(f"_m._{m}").alias(m) for m in _MOMENTS])


def offset_curve(pairs: DataFrame, keys: Sequence[str], reach: int, a: str = "old", b: str = "new",
                 index: str = "frame", size: int = BLOCK) -> DataFrame:
    """Pearson r of the overlap at each lag; -1 where it is under half the shorter version, or flat."""
    keys = list(keys)
    sizes = pairs.groupBy(*keys).agg(F.count(a).alias("_na"), F.count(b).alias("_nb"))
    return _overlap_r(lag_sums(pairs, keys, -reach, reach, a, b, index, size).join(sizes, keys), keys)


def _overlap_r(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments and both versions' lengths (_na, _nb) -> (keys, lag, r)."""
    least = F.greatest(F.lit(1), F.floor(F.least("_na", "_nb") / 2))
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    # Below these a version's spread can't be told from the rounding of its sums.
    moves = (va > F.greatest(F.lit(1e-9), F.col("saa") * 1e-13)) & (vb > F.greatest(F.lit(1e-9), F.col("sbb") * 1e-13))
    r = F.when((n >= least) & moves, cov / F.sqrt(va * vb)).otherwise(-1.0)
    return sums.select(*keys, "lag", r.alias("r"))


def peaks(curve: DataFrame, keys: Sequence[str], x: str = "lag", y: str = "r", edges: bool = True) -> DataFrame:
    """Adds `_left`, `_right` and `peak`: at least as high as both neighbours (an edge counts, or not)."""
    w = Window.partitionBy(*keys).orderBy(x)
    out = curve.withColumn("_left", F.lag(y).over(w)).withColumn("_right", F.lead(y).over(w))
    missing = F.lit(edges)
    return out.withColumn("peak", F.coalesce(F.col(y) >= F.col("_left"), missing)
                          & F.coalesce(F.col(y) >= F.col("_right"), missing))


def best_lag(curve: DataFrame, keys: Sequence[str], x: str = "lag", y: str = "r", tie: float = C.TIE_R) -> DataFrame:
    """The best r, and among peaks within `tie` of it the smallest shift (the earlier of two)."""
    keys = list(keys)
    top = Window.partitionBy(*keys)
    near = peaks(curve, keys, x, y).withColumn("_top", F.max(y).over(top)).where(
        F.col("peak") & (F.col(y) >= F.col("_top") - tie))
    order = F.struct(F.abs(F.col(x)).alias("a"), F.col(x).alias("b"))
    return near.groupBy(*keys).agg(F.min_by(x, order).alias(x), F.min_by(y, order).alias(y))


def vertex(left: Column, mid: Column, right: Column) -> Column:
    """Sub-step peak by a parabola through three points; 0 when it is not concave."""
    bend = left - 2.0 * mid + right
    return F.coalesce(F.when(bend < 0, 0.5 * (left - right) / bend), F.lit(0.0))


def best_and_runner_up(curve: DataFrame, keys: Sequence[str], away: int, x: str = "lag", y: str = "r") -> DataFrame:
    """Best lag refined below a step, whether it sits at the search's edge, and the best other
    interior peak more than `away` steps from it with the margin between them."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    first = F.struct(F.col(y), (-F.col(x)).alias("e"))
    marked = (peaks(curve, keys, x, y, edges=False)
              .withColumn("_best", F.max(first).over(whole)).withColumn("_at", -F.col("_best.e")))
    here = F.col(x) == F.col("_at")
    other = F.col("peak") & (F.abs(F.col(x) - F.col("_at")) > away)
    refined = F.col(x) + F.when(F.col("_left").isNull() | F.col("_right").isNull(), 0.0).otherwise(
        vertex(F.col("_left"), F.col(y), F.col("_right")))
    return marked.groupBy(*keys).agg(
        F.max(F.when(here, refined)).alias("lag"), F.max(F.when(here, F.col(y))).alias("r"),
        F.max(F.when(here, F.col("_left").isNull() | F.col("_right").isNull())).alias("edge"),
        F.max(F.when(other, first)).alias("_other")).select(
        *keys, "lag", "r", "edge", (F.col("r") - F.col(f"_other.{y}")).alias("margin"),
        (-F.col("_other.e")).alias("runner_up"))


def global_offset(pairs: DataFrame, keys: Sequence[str], reach: int, size: int = BLOCK) -> DataFrame:
    """(lag, r) that best lines up the new version with the old as a whole."""
    best = best_lag(offset_curve(pairs, keys, reach, size=size), keys)
    return best.select(*keys, "lag", F.round("r", 3).alias("r"))


def local_lags(pairs: DataFrame, keys: Sequence[str], width: int, hop: int, reach: int,
               flat: float = C.FLAT_DB, min_r: float = C.MIN_MATCH_R, fill: float = C.FLOOR_DB,
               index: str = "frame", size: int = BLOCK) -> DataFrame:
    """Where each window of the old version sits in the new one: start, lag, r per window.

    A flat window has neither; one whose best r is under `min_r` has r only. Past either end the
    new version reads `fill`. The last partial window is left out.
    """
    keys = list(keys)
    size = max(1, max(size, 2 * (width + reach)) // hop) * hop
    window_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("lag", T.IntegerType()),
                                            T.StructField("r", T.DoubleType())]))

    @F.pandas_udf(window_type)
    def best_of(blk: pd.Series, at: pd.Series, xs: pd.Series, ys: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for k, i, x, y, n in zip(blk, at, xs, ys, length):
            base = int(k) * size
            span = min(width, int(n))
            starts = np.arange(base, min(base + size, max(1, int(n) - span + 1)), hop)
            if not span or not len(starts):
                out.append([])
                continue
            own = int(starts[-1]) - base + span
            old = K.dense(i, x, base, own)
            new = np.nan_to_num(K.dense(i, y, base - reach, own + 2 * reach), nan=fill)
            still, lag, r = K.window_peaks(old, new, starts - base, span, reach, flat, C.TIE_R)
            out.append([{"start": int(s), "lag": None if f else int(g), "r": None if f else float(v)} for s, f, g, v in zip(starts, still, lag, r)])
        return pd.Series(out)

    lengths = pairs.groupBy(*keys).agg(F.count("old").alias("_n"))
    blocks = pack(pairs, keys, index, ["old", "new"], size, reach, width + reach).join(lengths, keys)
    found = blocks.select(*keys, F.explode(best_of("_blk", index, "old", "new", "_n")).alias("_w"))
    return found.select(*keys, "_w.start", F.when(F.col("_w.r") >= min_r, F.col("_w.lag")).alias("lag"), F.round("_w.r", 3).alias("r"))


def classify_lags(windows: DataFrame, offsets: DataFrame, keys: Sequence[str], fps: float = C.FPS,
                  search_s: float = C.COMPARE_SEARCH_S) -> DataFrame:
    """kind per pair: shift, tempo, moved or unconfirmed.

    `windows` is local_lags() (start and lag in frames), `offsets` global_offset() (lag, r).
    """
    keys = list(keys)
    agree_s = C.AGREE_S + 1e-9
    base = windows.join(offsets.select(*keys, F.col("lag").alias("_off"), F.col("r").alias("_off_r")), keys)
    base = settle(base.withColumn("_t", F.col("start") / fps).withColumn("_lag", F.col("lag") / fps).withColumn(
        "_offset", F.col("_off") / fps))
    matched = F.col("lag").isNotNull()
    near = F.abs(F.col("_lag") - F.col("_offset")) <= agree_s
    counts = base.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count("lag").alias("matched"), F.count("r").alias("voting"),
        F.avg(F.when(matched, near.cast("int"))).alias("agree"),
        F.avg(F.when(matched, (F.abs("_lag") <= agree_s).cast("int"))).alias("at_zero"),
        F.count(F.when(matched & (F.abs(F.col("_lag") - F.col("_offset")) > C.AGREE_S), 1)).alias("moved"),
        (F.max(F.when(matched, F.col("_t"))) - F.min(F.when(matched, F.col("_t")))).alias("span"),
        F.max("_offset").alias("offset"), F.max("_off_r").alias("offset_r"),
        F.min("_lag").alias("lag_min"), F.max("_lag").alias("lag_max"),
        F.min(F.when(matched & (F.abs(F.col("_lag") - F.col("_offset")) > C.AGREE_S), F.col("_t"))).alias("moved_from"))
    slope = theil_sen(base.where(matched), keys, "_t", "_lag")
    tilted = settle(base.where(matched).join(slope, keys).withColumn(
        "_rest", F.col("_lag") - F.col("slope") * F.col("_t")))
    line = exact_percentiles(tilted, keys, "_rest", {"_level": 0.5})
    on_line = tilted.join(line, keys).groupBy(*keys).agg(
        F.avg((F.abs(F.col("_rest") - F.col("_level")) <= agree_s).cast("int")).alias("on_line"), F.max("slope").alias("slope"))
    all_ = counts.join(on_line, keys, "left")
    beyond = (F.abs("offset") > search_s) & ((F.col("at_zero") < 1 / 3) | (F.col("offset_r") >= 0.9))
    kind = (F.when(F.col("matched") == 0, "unconfirmed")
            .when((F.col("agree") == 1.0) & (F.col("matched") >= F.col("voting") / 2), "shift")
            .when((F.col("offset_r") >= 0.8) & ((F.col("at_zero") == 1.0) | (F.col("agree") >= 2 / 3) | beyond), "shift")
            .when((F.col("matched") >= 3) & (F.col("span") > 0) & (F.col("on_line") >= 0.7)
                  & (F.abs("slope") * F.col("span") > C.AGREE_S), "tempo")
            .when(F.col("moved") == 0, "unconfirmed").otherwise("moved"))
    line_text = (F.when(kind == "shift", F.format_string("one shift of %+.2f s: %d of %d windows matched",
                                                         "offset", "matched", "windows"))
                 .when(kind == "tempo", F.format_string("lags drift %+.2f s a minute", F.col("slope") * 60))
                 .when(kind == "moved", F.format_string("material moved from %.0f s on, lags %+.2f to %+.2f s",
                                                        "moved_from", "lag_min", "lag_max"))
                 .otherwise(F.format_string("%d of %d windows matched: not confirmed", "matched", "windows")))
    return all_.select(*keys, kind.alias("kind"), line_text.alias("diagnosis"), "offset", "offset_r", "matched",
                       "windows", "agree", "at_zero", F.coalesce("slope", F.lit(0.0)).alias("slope"))


# ---- reading one version on the other's frames
def aligned_pair(pairs: DataFrame, lags: DataFrame, keys: Sequence[str], lag: str = "lag", fill: float | None = None,
                 fps: float = C.FPS, index: str = "frame", ratio: str | None = None, size: int = BLOCK) -> DataFrame:
    """(keys, frame, old, new, both): the new version read `lag` seconds later on the old frames.

    The frames span both versions once aligned. With `fill`, what a version lacks reads that
    value; `both` says whether the frame lies inside both.
    """
    keys = list(keys)
    lags = settle(lags)
    old = pairs.where(F.col("old").isNotNull()).select(*keys, index, "old")
    new = pairs.where(F.col("new").isNotNull()).select(*keys, index, F.col("new").alias("_new"))
    sizes = (pairs.groupBy(*keys).agg(F.count("old").alias("_no"), F.count("new").alias("_nn"))
             .join(lags.select(*keys, F.col(lag).alias("_lag"), *([F.col(ratio).alias("_ratio")] if ratio else [])), keys))
    span = F.greatest(F.col("_no"), F.ceil(F.col("_nn") - F.col("_lag") * fps)).cast("bigint")
    spine = spread_index(sizes.withColumn("_count", span), keys, "_count", index, size).join(
        sizes.drop("_count"), keys)
    rate = F.col("_ratio") if ratio else F.lit(1.0)
    at = F.col("_lag") * fps + F.col(index) / rate
    placed = spine.withColumn("_pos", at)
    read = sample_linear(placed, new.withColumnRenamed(index, "frame"), keys, "_pos", "_new", "_read", size=size)
    inside = (F.col("_pos") >= 0) & (F.col("_pos") <= F.col("_nn") - 1)
    joined = read.join(old, [*keys, index], "left")
    lit = F.lit(fill).cast("double")
    return joined.select(*keys, index, F.coalesce(F.col("old"), lit).alias("old"),
                         F.when(inside, F.col("_read")).otherwise(lit).alias("new"),
                         (inside & (F.col(index) < F.col("_no"))).alias("both"))


def onset_alignment(pairs: DataFrame, lags: DataFrame, keys: Sequence[str], fps: float = C.FPS,
                    ratio: str | None = None, size: int = BLOCK) -> DataFrame:
    """r of the two onset series with the new one read `lag` s later; 0 when flat or barely overlapping."""
    keys = list(keys)
    moved = aligned_pair(pairs, lags, keys, fps=fps, ratio=ratio, size=size).where("both")
    r = moved.groupBy(*keys).agg(safe_corr(F.col("old"), F.col("new")).alias("_r"), F.stddev_pop("old").alias("_a"),
                                 F.stddev_pop("new").alias("_b"), F.count("*").alias("_n"))
    ok = (F.col("_n") >= 2) & (F.col("_a") >= 1e-12) & (F.col("_b") >= 1e-12)
    found = r.select(*keys, F.when(ok, F.col("_r")).otherwise(0.0).alias("r"))
    return lags.select(*keys).join(found, keys, "left").fillna(0.0, subset=["r"])


def band_shift(pairs: DataFrame, lags: DataFrame, keys: Sequence[str], reach: int, size: int = BLOCK) -> DataFrame:
    """Where a band lines up best, when that is clearly elsewhere than at the pair's own lag (frames)."""
    keys = list(keys)
    curve = settle(offset_curve(pairs, keys, reach, size=size))
    best = best_lag(curve, keys).select(*keys, F.col("lag").alias("_at"), F.col("r").alias("_r"))
    mix = F.least(F.greatest(F.col("_mix"), F.lit(-reach)), F.lit(reach))
    own = lags.select(*keys, F.rint(F.col("lag").cast("double")).cast("int").alias("_mix")).withColumn("_mix", mix)
    at_mix = curve.join(own, keys).where(F.col("lag") == F.col("_mix")).select(*keys, "_mix", F.col("r").alias("_r_mix"))
    moved = ((F.col("_r") >= C.VOCAL_MOVED_R) & (F.col("_r") - F.col("_r_mix") >= C.VOCAL_MOVED_GAIN)
             & (F.col("_at") != F.col("_mix")))
    return best.join(at_mix, keys).select(*keys, F.when(moved, F.col("_at")).alias("lag"),
                                          F.when(moved, F.round("_r", 2)).alias("r"))


# ---- bars and sections
def bar_number(frame: Column, downbeat: Column, bar_s: Column, fps: float) -> Column:
    """The bar a frame belongs to: bar b owns frames from ceil(start*fps - 1e-9) on."""
    guess = F.floor((frame / fps - downbeat) / bar_s + 1e-9)
    # ceil(start*fps - 1e-9) <= frame holds exactly when start*fps <= frame + 1e-9.
    later = (downbeat + (guess + 1) * bar_s) * fps <= frame + 1e-9
    early = (downbeat + guess * bar_s) * fps > frame + 1e-9
    return (guess + 1 + F.when(later, 1).when(early, -1).otherwise(0)).cast("bigint")


def section_of(bar: Column, bars: int = C.SECTION_BARS) -> Column:
    """First bar of the section a bar is in; the bars before bar 1 are one pickup section (0)."""
    return F.when(bar <= 0, F.lit(0).cast("bigint")).otherwise(F.floor((bar - 1) / bars).cast("bigint") * bars + 1)


def section_matches(moved_mix: DataFrame, moved_voice: DataFrame, grids: DataFrame, keys: Sequence[str],
                    fps: float = C.FPS, index: str = "frame") -> DataFrame:
    """r of two bands per 8-bar section on the frames both versions have; NULL when under half of
    the section sounds. Inputs come from aligned_pair(fill=floor); `grids` has downbeat and bar_s."""
    keys = list(keys)
    peak = moved_mix.where("both").groupBy(*keys).agg(F.max("old").alias("_peak"))
    voice = moved_voice.select(*keys, index, F.col("old").alias("_ov"), F.col("new").alias("_nv"))
    all_ = (moved_mix.join(voice, [*keys, index]).join(peak, keys).join(grids, keys)
            .withColumn("bar", bar_number(F.col(index), F.col("downbeat"), F.col("bar_s"), fps)))
    sounding = (F.col("old") > F.col("_peak") - C.AUDIBLE_DB).cast("int")
    use = F.col("both")

    def r(a, b):
        ok = ((F.stddev_pop(F.when(use, F.col(a))) >= 1e-6) & (F.stddev_pop(F.when(use, F.col(b))) >= 1e-6)
              & (F.count(F.when(use, 1)) >= 2) & (F.avg(sounding) >= 0.5))
        return F.when(ok, F.round(safe_corr(F.when(use, F.col(a)), F.when(use, F.col(b))), 3))

    return all_.groupBy(*keys, section_of(F.col("bar")).alias("section")).agg(
        F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"), F.count("*").alias("frames"),
        r("_ov", "_nv").alias("vocal_r"), r("old", "new").alias("mix_r")).where(F.col("frames") >= 2).drop("section")


def common_scale(moved: DataFrame, raw_old: DataFrame, keys: Sequence[str], least: int = C.FPS,
                 floor: float = C.FLOOR_DB) -> DataFrame:
    """Both versions on the old one's 0..1 range, their overall gain difference taken out first.

    `moved` is aligned_pair(fill=floor); `raw_old` (keys, old) the old version as it is.
    """
    keys = list(keys)
    tops = settle(moved.groupBy(*keys).agg(F.max("old").alias("_to"), F.max("new").alias("_tn")))
    placed = moved.join(tops, keys)
    loud = ((F.col("old") > F.col("_to") - C.AUDIBLE_DB) & (F.col("new") > F.col("_tn") - C.AUDIBLE_DB)
            & (F.col("old") > floor) & (F.col("new") > floor))
    joint = placed.where(loud).withColumn("_gain", F.col("new") - F.col("old"))
    enough = joint.groupBy(*keys).agg(F.count("*").alias("_m"))
    gain = exact_percentiles(joint, keys, "_gain", {"_g": 0.5}).join(enough, keys)
    scale = exact_percentiles(raw_old, keys, "old", {"_lo": C.NORMALISE_LOW, "_hi": C.NORMALISE_HIGH})
    out = placed.join(gain, keys, "left").join(scale, keys)
    shift = F.when(F.col("_m") >= least, F.col("_g")).otherwise(0.0)
    span = F.col("_hi") - F.col("_lo")

    def put(x):
        return F.when(span > 1e-9, S.clamp((x - F.col("_lo")) / span)).otherwise(0.0)

    return out.select(*moved.columns[:-3], put(F.col("old")).alias("old"), put(F.col("new") - shift).alias("new"), "both")


def level_changes(scaled: DataFrame, grids: DataFrame, keys: Sequence[str], slide: int, fps: float = C.FPS,
                  index: str = "frame", size: int = BLOCK) -> DataFrame:
    """Per bar: the smallest mean |old - new| and the best r over slides of the new version within
    +-`slide` frames (r is NULL where either barely moves). Edges repeat their last value."""
    keys = list(keys)
    slides = list(range(-slide, slide + 1))
    ends = scaled.groupBy(*keys).agg(F.min_by("new", index).alias("_first"), F.max_by("new", index).alias("_last"))
    src = scaled.join(ends, keys).join(grids, keys).withColumn(
        "bar", bar_number(F.col(index), F.col("downbeat"), F.col("bar_s"), fps))

    def read(s):
        if s == 0:
            return lambda w: F.col("new")
        edge = "_first" if s > 0 else "_last"
        return lambda w: F.coalesce((F.lag("new", s) if s > 0 else F.lead("new", -s)).over(w), F.col(edge))

    wide = over_blocks(src, keys, index, {f"_m{k}": read(s) for k, s in enumerate(slides)}, slide, slide, size)
    aggs = [F.stddev_pop("old").alias("_so"), F.count("*").alias("_n")]
    for k in range(len(slides)):
        aggs += [F.avg(F.abs(F.col("old") - F.col(f"_m{k}"))).alias(f"_d{k}"),
                 F.stddev_pop(f"_m{k}").alias(f"_s{k}"), safe_corr(F.col("old"), F.col(f"_m{k}")).alias(f"_r{k}")]
    bars = wide.groupBy(*keys, "bar").agg(*aggs)
    active = [F.when((F.col("_so") > C.SHAPE_ACTIVITY) & (F.col(f"_s{k}") > C.SHAPE_ACTIVITY) & (F.col("_n") >= 2),
                     F.col(f"_r{k}")) for k in range(len(slides))]
    deltas = [F.col(f"_d{k}") for k in range(len(slides))]
    pick = (lambda f, cs: f(*cs) if len(cs) > 1 else cs[0])
    return bars.select(*keys, "bar", pick(F.least, deltas).alias("delta"), pick(F.greatest, active).alias("r"))


def rhythm_profile(df: DataFrame, keys: Sequence[str], value: str, grids: DataFrame, per_bar: int = 4,
                   fps: float = C.FPS, index: str = "frame") -> DataFrame:
    """Energy per 16th slot of each bar. A slot is centred on its 16th, so the last half slot of a
    bar belongs to the next bar's first."""
    keys = list(keys)
    slots = 4 * per_bar
    step = F.col("bar_s") / slots
    shifted = bar_number(F.col(index), F.col("downbeat") - step / 2, step, fps) - 1
    return df.join(grids, keys).select(
        *keys, (F.floor(shifted / slots) + 1).cast("bigint").alias("bar"),
        F.pmod(shifted, F.lit(slots).cast("bigint")).alias("slot"), F.col(value).alias("_v"),
    ).groupBy(*keys, "bar", "slot").agg(F.sum("_v").alias("energy"))


def rhythm_changes(moved_flux: DataFrame, grids: DataFrame, keys: Sequence[str], per_bar: int = 4,
                   fps: float = C.FPS, index: str = "frame") -> DataFrame:
    """Per bar: r of the two square-rooted 16th profiles; NULL where neither sounds, 0 where one does.

    A bar sounds when its energy passes a fifth of the median of the series' positive bars."""
    keys = list(keys)
    slots = 4 * per_bar
    both = None
    for side in ("old", "new"):
        part = rhythm_profile(moved_flux, keys, side, grids, per_bar, fps, index).withColumnRenamed("energy", side)
        both = part if both is None else both.join(part, [*keys, "bar", "slot"])
    root_old, root_new = F.sqrt(F.greatest("old", F.lit(0.0))), F.sqrt(F.greatest("new", F.lit(0.0)))
    # Slots with no frame read 0: they join the moments through the slot count alone.
    sa, sb = F.sum(root_old), F.sum(root_new)
    saa, sbb, sab = F.sum(F.greatest("old", F.lit(0.0))), F.sum(F.greatest("new", F.lit(0.0))), F.sum(root_old * root_new)
    bars = settle(both.groupBy(*keys, "bar").agg(
        F.sum("old").alias("_to"), F.sum("new").alias("_tn"),
        (saa / slots - (sa / slots) * (sa / slots)).alias("_va"), (sbb / slots - (sb / slots) * (sb / slots)).alias("_vb"),
        (sab / slots - (sa / slots) * (sb / slots)).alias("_cov"),
        F.max(F.abs(root_old - root_new)).alias("_gap")))
    typical_old = exact_percentiles(bars.where(F.col("_to") > 0), keys, "_to", {"_mo": 0.5})
    typical_new = exact_percentiles(bars.where(F.col("_tn") > 0), keys, "_tn", {"_mn": 0.5})
    placed = bars.join(typical_old, keys, "left").join(typical_new, keys, "left")
    so = F.col("_to") > C.RHYTHM_ACTIVITY * F.greatest(F.coalesce("_mo", F.lit(0.0)), F.lit(1e-12))
    sn = F.col("_tn") > C.RHYTHM_ACTIVITY * F.greatest(F.coalesce("_mn", F.lit(0.0)), F.lit(1e-12))
    moving = (F.col("_va") > 1e-24) & (F.col("_vb") > 1e-24)
    r = (F.when(so & sn & moving, F.col("_cov") / F.sqrt(F.col("_va") * F.col("_vb")))
         .when(so & sn, F.when(F.col("_gap") <= 1e-8, 1.0).otherwise(0.0)).when(so != sn, 0.0))
    return placed.select(*keys, "bar", r.alias("r"))


def bar_changes(levels: DataFrame, rhythms: DataFrame | None, voices: DataFrame, keys: Sequence[str],
                max_delta: float = C.DELTA_THRESHOLD, min_r: float = C.SHAPE_THRESHOLD,
                rhythm_r: float = C.RHYTHM_THRESHOLD, max_new_voice: float = C.NEW_VOICE_THRESHOLD) -> DataFrame:
    """Per bar: the envelopes that moved (worst first), the largest delta and the newly sounding share.

    `levels` (keys, bar, key, ord, delta, r), `rhythms` (keys, bar, key, ord, r), `voices`
    (keys, bar, new_voice)."""
    keys = list(keys)
    d, r = F.round("delta", 3), F.round("r", 3)
    level_rows = levels.select(*keys, "bar", "key", "ord", d.alias("delta"),
                               F.when((d > max_delta) | (r < min_r), F.greatest(
                                   d - max_delta, F.coalesce(min_r - r, F.lit(0.0)))).alias("excess"))
    rows = level_rows
    if rhythms is not None:
        rows = rows.unionByName(rhythms.select(
            *keys, "bar", "key", "ord", F.lit(None).cast("double").alias("delta"),
            F.when(F.col("r") < rhythm_r, rhythm_r - F.col("r")).alias("excess")))
    flagged = F.collect_list(F.when(F.col("excess").isNotNull(), F.struct(
        (-F.round("excess", 9)).alias("e"), F.col("ord"), F.col("key"))))
    out = rows.groupBy(*keys, "bar").agg(F.coalesce(F.max("delta"), F.lit(0.0)).alias("delta"),
                                         F.array_sort(flagged).alias("_f"))
    return out.join(voices, [*keys, "bar"]).select(
        *keys, "bar", "delta", F.round("new_voice", 3).alias("new_voice"), F.col("_f.key").alias("envelopes"),
        ((F.size("_f") > 0) | F.coalesce(F.col("new_voice") > max_new_voice, F.lit(False))).alias("changed"))


def new_voice_share(scaled: DataFrame, grids: DataFrame, keys: Sequence[str], fps: float = C.FPS,
                    index: str = "frame") -> DataFrame:
    """Share of each bar's frames where the voice sounds in the new version and not in the old."""
    fresh = (F.col("new") > C.NEW_VOICE_ON) & (F.col("old") < C.NEW_VOICE_OFF)
    return scaled.join(grids, list(keys)).groupBy(
        *keys, bar_number(F.col(index), F.col("downbeat"), F.col("bar_s"), fps).alias("bar")).agg(
        F.avg(fresh.cast("int")).alias("new_voice"))


def verdict(kinds: DataFrame, audible_old: DataFrame, audible_new: DataFrame, changed_bars: DataFrame,
            keys: Sequence[str], tolerance: float = C.TOLERANCE_S, fps: float = C.FPS,
            silent_start: float = 0.0) -> DataFrame:
    """One row per pair: remux, rerender, new grid or offset, with its exit code.

    `kinds` has kind and lag_s; changed bars outrank an offset; a shift that adds or drops sound at
    the head is a new grid.
    """
    keys = list(keys)
    heads = audible_old.select(*keys, (F.col("first_frame") / fps).alias("_ho")).join(
        audible_new.select(*keys, (F.col("first_frame") / fps).alias("_hn")), keys)
    changed = changed_bars.groupBy(*keys).agg(F.count(F.when(F.col("changed"), 1)).alias("changed_bars"))
    all_ = kinds.join(heads, keys, "left").join(changed, keys, "left").fillna(0, subset=["changed_bars"])
    shifted = F.abs("lag_s") > tolerance
    expected = F.col("_ho") + F.col("lag_s")
    head = shifted & ((expected - F.col("_hn") > C.HEAD_MARGIN_S) | (expected < -C.HEAD_MARGIN_S))
    name = (F.when((F.col("kind") != "shift") | F.coalesce(head, F.lit(False)), "new grid")
            .when(F.col("changed_bars") > 0, "rerender").when(shifted, "offset").otherwise("remux"))
    code = F.create_map(*[F.lit(x) for kv in C.EXIT_CODES.items() for x in kv])[name]
    return all_.select(*keys, "kind", "lag_s", "changed_bars", name.alias("verdict"), code.alias("exit_code"),
                       F.when(name != "new grid", F.round(F.lit(silent_start) + F.col("lag_s"), 4)).alias("new_silent_start"))


# ---- speed changes and fine lags
def tempo_change(pairs: DataFrame, windows: DataFrame, keys: Sequence[str], fps: float = C.FPS,
                 reach_s: float = 5.0, tolerance: float = C.TOLERANCE_S, onset_pairs: DataFrame | None = None,
                 size: int = BLOCK) -> DataFrame:
    """Pairs whose new version is the old one at another speed: ratio, lag_s, r.

    Trial ratios lie around the windows' drift and the ratio of audible lengths, first in
    0.1 % then in 0.01 % steps. All trials of a block are warped and correlated in one step.
    """
    keys = list(keys)
    matched = settle(windows.where(F.col("lag").isNotNull()).withColumn("_t", F.col("start") / fps).withColumn(
        "_l", F.col("lag") / fps))
    drift = theil_sen(matched, keys, "_t", "_l").join(matched.groupBy(*keys).agg(
        F.count("*").alias("_m"), (F.max("_t") - F.min("_t")).alias("_span")), keys)
    drift = drift.where((F.col("_m") >= 3) & (F.col("_span") > 0) & (F.col("slope") > -0.9)).select(
        *keys, (1.0 / (1.0 + F.col("slope"))).alias("guess"), F.when(F.col("_m") >= 5, 1).otherwise(0).alias("line"))
    lengths = None
    for side in ("old", "new"):
        from tidewheel.operators.series import audible_span

        part = audible_span(pairs.where(F.col(side).isNotNull()), keys, side).select(
            *keys, (F.col("last_frame") - F.col("first_frame")).alias(f"_{side}"))
        lengths = part if lengths is None else lengths.join(part, keys)
    by_length = lengths.where(F.col("_new") > 0).select(*keys, (F.col("_old") / F.col("_new")).alias("guess"), F.lit(0).alias("line"))
    guesses = settle(drift.unionByName(by_length).where(F.col("guess").between(0.5, 2.0)))

    def trials(centres: DataFrame, steps: int, step: float) -> DataFrame:
        spread = F.explode(F.transform(F.sequence(F.lit(-steps), F.lit(steps)), lambda k: F.col("guess") * (1.0 + step * k)))
        return centres.select(*keys, spread.alias("ratio")).distinct()

    def peaks_of(ratios: DataFrame) -> DataFrame:
        # A series has tens of trials, each with a row of moments.
        tried = settle(ratios)
        with arrow_batches(pairs.sparkSession, 256):
            return settle(warped_peaks(pairs, tried, keys, round(reach_s * fps), fps, size))

    coarse = peaks_of(trials(guesses, 5, 0.001))
    best = F.max(F.struct("r", "ratio", "lag_s"))
    first = coarse.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.ratio").alias("guess"))
    followed = guesses.where(F.col("line") == 1).select(*keys, F.col("guess").alias("ratio"))
    second = peaks_of(trials(first, 10, 0.0001).unionByName(followed).distinct())
    all_ = coarse.unionByName(second)
    top = all_.groupBy(*keys).agg(best.alias("_b"))
    line = second.join(followed.withColumnRenamed("ratio", "_f"), keys).where(F.col("ratio") == F.col("_f")).groupBy(
        *keys).agg(best.alias("_line"))
    chosen = top.join(line, keys, "left").withColumn(
        "_b", F.when(F.col("_line.r") >= F.col("_b.r") - 0.005, F.col("_line")).otherwise(F.col("_b")))
    plain = offset_curve(pairs, keys, round(reach_s * fps), size=size).groupBy(*keys).agg(
        F.max(F.struct("r", (-F.col("lag")).alias("l"))).alias("_p"))
    sized = pairs.groupBy(*keys).agg(F.count("old").alias("_no"))
    found = chosen.join(plain, keys).join(sized, keys).select(
        *keys, F.col("_b.ratio").alias("ratio"), (F.col("_b.lag_s") / F.col("_b.ratio")).alias("lag_s"),
        F.round("_b.r", 3).alias("r"), F.col("_b.r").alias("_r"), F.col("_p.r").alias("_plain"),
        (-F.col("_p.l") / fps).alias("_plain_lag"), (F.abs(1.0 - 1.0 / F.col("_b.ratio")) * F.col("_no") / fps).alias("_drift"))
    found = settle(found.where((F.col("_r") >= C.STRETCH_R) & (F.col("_drift") > tolerance)))
    gains = F.col("_r") >= F.col("_plain") + C.STRETCH_GAIN
    if onset_pairs is None:
        return found.where(gains).select(*keys, "ratio", "lag_s", "r")
    before = onset_alignment(onset_pairs, found.select(*keys, F.col("_plain_lag").alias("lag")), keys, fps, size=size)
    after = onset_alignment(onset_pairs, found.select(*keys, F.col("lag_s").alias("lag"), "ratio"), keys, fps, "ratio", size)
    proven = (F.col("_before") < C.ONSETS_ALIGNED) & (F.col("_after") >= C.ONSETS_STRETCHED)
    return (found.join(before.withColumnRenamed("r", "_before"), keys).join(after.withColumnRenamed("r", "_after"), keys)
            .where(gains | proven).select(*keys, "ratio", "lag_s", "r"))


def warped_curves(pairs: DataFrame, ratios: DataFrame, keys: Sequence[str], reach: int, size: int = BLOCK) -> DataFrame:
    """r of the old version against the new one stretched by each trial ratio, at each lag: (keys, ratio, lag, r).

    A block of old frames meets the few blocks of the new version that its trials read, once for all trials. It resamples
    them in place and gives one set of moments a trial and lag, summed over a task's blocks first; no frame of a trial is a row.
    """
    keys = list(keys)
    size = max(size, 4 * (reach + 1))
    lags = 2 * reach + 1
    series = F.struct(*keys).alias("_g")
    sizes = pairs.groupBy(series).agg(F.count("old").alias("_na"), F.count("new").alias("_nn"))
    # A key has a few tens of trials.
    trials = ratios.groupBy(series).agg(F.sort_array(F.collect_set("ratio")).alias("_ratios")).join(sizes, "_g")
    named = pairs.withColumn("_g", series)
    old = pack(named.where("old IS NOT NULL").withColumn("old", F.col("old").cast("double")), ["_g"], "frame", ["old"], size).withColumnsRenamed({"frame": "_at", "_blk": "_b"})
    new = pack(named.where("new IS NOT NULL").withColumn("new", F.col("new").cast("double")), ["_g"], "frame", ["new"], size)
    first, last = F.col("_b") * size - reach, (F.col("_b") + 1) * size + reach
    slowest, fastest = F.array_min("_ratios"), F.array_max("_ratios")
    low = F.greatest(F.floor(first / F.when(first < 0, slowest).otherwise(fastest)) - 1, F.lit(0))
    high = F.ceil(last / slowest) + 1
    blocks = F.sequence(F.floor(low / size).cast("bigint"), F.floor(F.least(high, F.greatest("_nn", F.lit(1))) / size).cast("bigint"))
    asked = old.join(trials, "_g").where(low <= F.col("_nn")).withColumn("_blk", F.explode(blocks))
    met = asked.join(new, ["_g", "_blk"]).groupBy("_g", "_b").agg(
        F.any_value("_at").alias("_at"), F.any_value("old").alias("old"), F.any_value("_ratios").alias("_ratios"), F.any_value("_nn").alias("_nn"),
        F.array_sort(F.collect_list(F.struct("_blk", "frame", "new"))).alias("_new"))

    def moments(batches):
        for batch in batches:
            found: dict[tuple, np.ndarray] = {}
            heads: dict[tuple, int] = {}
            names = [repr(g) for g in batch.column("_g").to_pylist()]
            for row, name in enumerate(names):
                start, total = batch.column("_b")[row].as_py() * size, batch.column("_nn")[row].as_py()
                frames, values = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("_at", "old"))
                own = int(frames[-1]) + 1 - start
                left = K.dense(frames, values, start, own)
                pieces = batch.column("_new")[row].values
                at, read = (np.concatenate([p.values.to_numpy(zero_copy_only=False) for p in pieces.field(c)]) for c in ("frame", "new"))
                wanted = np.arange(start - reach, start + own + reach, dtype=np.float64)
                ratios_ = batch.column("_ratios")[row].values.to_numpy(zero_copy_only=False)
                # A slice of trials at a time, whatever the block's size.
                for first in range(0, len(ratios_), each := max(1, 4_000_000 // len(wanted))):
                    some = ratios_[first:first + each, None]
                    inside = (wanted >= 0) & (wanted < np.rint(total * some))
                    right = np.where(inside, np.interp(wanted / some, at, read), np.nan)
                    for ratio, summed in zip(some[:, 0].tolist(), K.lag_moments_each(left, right, lags)):
                        key = (name, ratio)
                        found[key] = found[key] + summed if key in found else summed
                        heads.setdefault(key, row)
            if found:
                columns = [pa.array([m[i] for m in found.values()], pa.list_(pa.float64())) for i in range(len(_MOMENTS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_g").take(pa.array([heads[k] for k in found])), pa.array([k[1] for k in found], pa.float64()), *columns],
                    names=["_g", "ratio", *(f"_{m}" for m in _MOMENTS)])

    schema = T.StructType([met.select("_g").schema["_g"], T.StructField("ratio", T.DoubleType()), *[T.StructField(f"_{m}", T.ArrayType(T.DoubleType())) for m in _MOMENTS]])
    rows = met.mapInArrow(moments, schema).select("_g", "ratio", F.posexplode(F.arrays_zip(*[f"_{m}" for m in _MOMENTS])).alias("_k", "_m"))
    sums = rows.groupBy("_g", "ratio", (F.col("_k") - reach).cast("int").alias("lag")).agg(*[F.sum(f"_m._{m}").alias(m) for m in _MOMENTS])
    lengths = sizes.select("_g", "_na", "_nn")
    placed = sums.join(lengths, "_g").withColumn("_nb", F.rint(F.col("_nn") * F.col("ratio")))
    return _overlap_r(placed, ["_g", "ratio"]).select(*[F.col("_g")[k].alias(k) for k in keys], "ratio", "lag", "r")


def warped_peaks(pairs: DataFrame, ratios: DataFrame, keys: Sequence[str], reach: int, fps: float = C.FPS,
                 size: int = BLOCK) -> DataFrame:
    """Best (r, lag_s) of each trial ratio: the offset curve's peak, read between whole frames."""
    keys = list(keys)
    trial = [*keys, "ratio"]
    curve = peaks(warped_curves(pairs, ratios, keys, reach, size), trial)
    top = curve.groupBy(*trial).agg(F.max(F.struct("r", (-F.col("lag")).alias("l"), "_left", "_right")).alias("_b"))
    left, mid, right = F.col("_b._left"), F.col("_b.r"), F.col("_b._right")
    usable = left.isNotNull() & right.isNotNull() & (F.least(left, right) > -1.0)
    shift = F.when(usable, S.clamp(vertex(left, mid, right), -0.5, 0.5)).otherwise(0.0)
    return top.withColumn("_s", shift).select(
        *trial, (mid - F.when(F.col("_s") != 0, 0.25 * (left - right) * F.col("_s")).otherwise(0.0)).alias("r"),
        ((-F.col("_b.l") + F.col("_s")) / fps).alias("lag_s"))


def fine_lag(segments: DataFrame, coarse: DataFrame, keys: Sequence[str], sr: int, reach_s: float = C.FINE_REACH_S) -> DataFrame:
    """The shift to the millisecond from sample segments.

    `segments` has one row per (keys, segment): old (samples) and new (samples with `reach` more
    either side), the new one cut at `base` samples. Agreeing segments' median wins over the
    coarse lag (keys, lag_s).
    """
    keys = list(keys)
    reach = round(reach_s * sr)

    @F.pandas_udf("double")
    def shift(old: pd.Series, new: pd.Series) -> pd.Series:
        pieces = [[np.asarray(x, dtype=np.float64) for x in side] for side in (old, new)]
        return pd.Series(K.phase_lags(*pieces, reach))

    answers = segments.withColumn("_a", (F.col("base") + shift("old", "new")) / sr).where(F.col("_a").isNotNull() & ~F.isnan("_a"))
    spread = answers.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max("_a") - F.min("_a")).alias("_d"))
    middle = exact_percentiles(answers, keys, "_a", {"_m": 0.5})
    sure = (F.col("_n") >= 2) & (F.col("_d") <= C.FINE_SPREAD_S)
    return coarse.join(spread.join(middle, keys), keys, "left").select(
        *keys, F.round(F.when(sure, F.col("_m")).otherwise(F.col("lag_s")), 4).alias("lag_s"))


def refine_peak(curve: DataFrame, coarse: DataFrame, keys: Sequence[str], fps: float = C.FPS) -> DataFrame:
    """A whole-frame lag moved to the vertex of the offset curve around it, at most half a frame."""
    keys = list(keys)
    placed = peaks(curve, keys).join(coarse.select(*keys, F.col("lag").alias("_at")), keys).where(F.col("lag") == F.col("_at"))
    usable = F.least("_left", "r", "_right") > -1.0
    shift = F.when(usable & F.col("_left").isNotNull() & F.col("_right").isNotNull(),
                   S.clamp(vertex(F.col("_left"), F.col("r"), F.col("_right")), -0.5, 0.5)).otherwise(0.0)
    return placed.select(*keys, ((F.col("_at") + shift) / fps).alias("lag_s"))


# ---- several bands, several members
def band_correlation(bands: DataFrame, keys: Sequence[str], reach: int, value: str = "member", ref: str = "master",
                     weight: str = "energy", size: int = BLOCK) -> DataFrame:
    """Correlation of a member with its master at each lag: the mean over bands of each band's
    cross-correlation, weighted by the member's energy in the band and normalised once by both
    whole energies. `weight` "energy" weighs by total level, "variance" by onset energy.
    """
    keys = list(keys)
    banded = [*keys, "band"]
    totals = bands.groupBy(*banded).agg(
        F.avg(value).alias("_mx"), F.avg(ref).alias("_my"), F.sum(value).alias("_sx"),
        (F.var_pop(value) * F.count(value)).alias("_vx"), (F.var_pop(ref) * F.count(ref)).alias("_vy"))
    moving = (F.sqrt("_vx") > 1e-9) & (F.sqrt("_vy") > 1e-9)
    w = F.when(moving, F.col("_sx") if weight == "energy" else F.col("_vx")).otherwise(0.0)
    whole = Window.partitionBy(*keys)
    weighed = settle(totals).withColumn("_w", w).withColumn("_tw", F.sum("_w").over(whole)).where(
        (F.col("_tw") > 0) & (F.col("_w") > 1e-4 * F.col("_tw")))
    weighed = weighed.withColumn("_w", F.col("_w") / F.sum("_w").over(whole))
    sums = lag_sums(bands, banded, -reach, reach, value, ref, size=size).join(weighed, banded)
    cross = F.col("sab") - F.col("_mx") * F.col("sb") - F.col("_my") * F.col("sa") + F.col("n") * F.col("_mx") * F.col("_my")
    return sums.groupBy(*keys, "lag").agg(F.sum(F.col("_w") * cross / F.sqrt(F.col("_vx") * F.col("_vy"))).alias("r"))


def member_correlation(by_power: DataFrame, by_onset: DataFrame, keys: Sequence[str], agree: int) -> DataFrame:
    """One curve from two features: their mean where they peak within `agree` lags of each other,
    else the one that peaks higher; a feature a member lacks does not count."""
    keys = list(keys)

    def top(df, name):
        return df.groupBy(*keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("l"))).alias(name))

    both = (by_power.withColumnRenamed("r", "_p").join(by_onset.withColumnRenamed("r", "_o"), [*keys, "lag"], "full")
            .join(top(by_power, "_tp"), keys, "left").join(top(by_onset, "_to"), keys, "left"))
    close = F.abs(F.col("_tp.l") - F.col("_to.l")) <= agree
    r = (F.when(F.col("_tp").isNull(), F.col("_o")).when(F.col("_to").isNull(), F.col("_p"))
         .when(close, (F.col("_p") + F.col("_o")) / 2.0)
         .when(F.col("_tp.r") >= F.col("_to.r"), F.col("_p")).otherwise(F.col("_o")))
    return both.select(*keys, "lag", r.alias("r"))


def align_group(curve: DataFrame, group: Sequence[str], member: str, given: DataFrame | None = None,
                fps: float = C.FPS) -> DataFrame:
    """Each member's lag on its master: lag_s, r, margin and status (auto, given, refused), and what it was judged by: its own best
    lag and r, whether that is sure, at the search's edge or an outlier, its runner-up, and the lag agreed on.

    A lag is trusted at r >= 0.2 with a margin >= 0.05 off the search's edge. The lag most trusted
    members share settles the repeaters near it; trusted members elsewhere are refused.
    `given` (group, member, lag_s) overrides.
    """
    from tidewheel.operators.aggregates import majority

    group = list(group)
    keys = [*group, member]
    curve = settle(curve)
    found = best_and_runner_up(curve, keys, round(C.RUNNER_UP_S * fps)).withColumn("lag_s", F.col("lag") / fps)
    sure = (F.col("r") >= C.STEM_MIN_R) & ~F.col("edge") & (F.col("margin").isNull() | (F.col("margin") >= C.STEM_MIN_MARGIN))
    found = settle(found.withColumn("sure", sure))
    trusted = found.where("sure")
    if given is not None:
        trusted = trusted.join(given.select(*keys), keys, "left_anti")
    voted = settle(majority(trusted.withColumn("lag_s", F.round("lag_s", 6)), group, "lag_s", member))
    agreed = voted.groupBy(*group).agg(F.max("agreed").alias("agreed"))
    spread = round(C.AGREE_S * fps)
    near = (peaks(curve, keys, edges=False).join(agreed, group).where(
        F.col("peak") & (F.abs(F.col("lag") - F.rint(F.col("agreed") * fps)) <= spread))
        .groupBy(*keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("l"), "_left", "_right")).alias("_n")))
    settled = near.select(*keys, F.col("_n.r").alias("_near_r"),
                          ((-F.col("_n.l") + vertex(F.col("_n._left"), F.col("_n.r"), F.col("_n._right"))) / fps).alias("_near_s"))
    all_ = (found.join(voted.select(*keys, "outlier"), keys, "left").join(agreed, group, "left").join(settled, keys, "left"))
    settles = (~F.col("sure") & (F.col("r") >= C.STEM_MIN_R) & ~F.col("edge") & F.col("agreed").isNotNull()
               & (F.col("_near_r") >= C.STEM_MIN_R) & (F.col("_near_r") >= F.col("r") - C.STEM_MIN_MARGIN))
    ok = F.col("sure") & ~F.coalesce("outlier", F.lit(False))
    lag_s = F.when(ok, F.col("lag_s")).when(settles, F.col("_near_s"))
    r = F.when(F.coalesce(settles, F.lit(False)), F.col("_near_r")).otherwise(F.col("r"))
    judged = [F.col("lag_s").alias("best_s"), F.col("r").alias("best_r"), "sure", "edge", F.coalesce("outlier", F.lit(False)).alias("outlier"),
              (F.col("runner_up") / fps).alias("runner_up_s"), "agreed"]
    out = all_.select(*keys, F.round(lag_s, 3).alias("lag_s"), F.round(r, 3).alias("r"), "margin",
                      F.when(lag_s.isNotNull(), "auto").otherwise("refused").alias("status"), *judged)
    if given is None:
        return out
    over = given.select(*keys, F.col("lag_s").alias("_g"))
    return out.join(over, keys, "left").withColumns({
        "lag_s": F.coalesce(F.round("_g", 3), "lag_s"), "status": F.when(F.col("_g").isNotNull(), "given").otherwise(F.col("status"))}).drop("_g")


def group_contract(aligned: DataFrame, sizes: DataFrame, masters: DataFrame, group: Sequence[str], member: str, rate: float,
                   tolerance_s: float = C.STEM_TOLERANCE_S, warn_s: float = C.TOLERANCE_S) -> DataFrame:
    """What becomes of every member: source (auto, given, none, refused), lag_s, r, gap_s, problem and warning.

    `aligned` is align_group()'s, `sizes` has (group, member, samples) of all members and `masters` (group, length), both at
    `rate` a second. A member with nothing to line up by (silence, a drone) stays at 0. Every member must end where its
    master does, to within `tolerance_s`; `gap_s` tells by how much it ends later. A given lag that a sure fit contradicts is a warning.
    """
    group = list(group)
    keys = [*group, member]
    all_ = sizes.select(*keys, "samples").join(aligned, keys, "left").join(masters.select(*group, "length"), group)
    source = F.coalesce("status", F.lit("none"))
    lag = F.when(F.col("status").isNull(), 0.0).otherwise(F.col("lag_s"))
    placed = all_.withColumns({"source": source, "lag_s": lag}).withColumn("gap_s", F.round(F.col("lag_s") + (F.col("samples") - F.col("length")) / rate, 3))
    refusal = (F.when(F.col("outlier"), F.format_string("lines up at %+.3f s (r %.2f), the other members at %+.3f s", "best_s", "best_r", F.coalesce("agreed", F.lit(0.0))))
               .when(F.col("edge"), F.format_string("fits best at the edge of the search, at %+.3f s (r %.2f)", "best_s", "best_r"))
               .when(F.col("best_r") < C.STEM_MIN_R, F.format_string("hardly matches its master anywhere (r %.2f at %+.3f s)", "best_r", "best_s"))
               .otherwise(F.format_string("fits nearly as well at %+.3f s as at %+.3f s (r %.2f)", "runner_up_s", "best_s", "best_r")))
    ends = F.format_string("ends %.2f s %s its master", F.abs("gap_s"), F.when(F.col("gap_s") > 0, "after").otherwise("before"))
    problem = F.when(F.col("source") == "refused", refusal).when(F.abs("gap_s") > tolerance_s, ends)
    warning = F.when((F.col("source") == "given") & F.col("sure") & (F.abs(F.col("best_s") - F.col("lag_s")) > warn_s),
                     F.format_string("given %+.3f s, but it lines up best at %+.3f s (r %.2f)", "lag_s", "best_s", "best_r"))
    return placed.select(*keys, "source", "lag_s", "r", "gap_s", problem.alias("problem"), warning.alias("warning"))


def with_voice(levels: DataFrame, members: DataFrame, group: Sequence[str], member: str, value: str, index: str = "frame") -> DataFrame:
    """The master's levels with `voc` taken from a member that is a voice (the first by name), else its own proxy; voc_source tells which."""
    group = list(group)
    voices = members.where(F.lower(member).isin(*C.VOICES))
    first = voices.groupBy(*group).agg(F.min(member).alias(member))
    sung = voices.join(first, [*group, member]).select(*group, index, F.col(value).alias("_sung"))
    named = levels.join(first.select(*group, F.lit(True).alias("_has")), group, "left").join(sung, [*group, index], "left")
    own = F.when(F.col("voc").isNotNull(), "mid-side proxy")
    return named.withColumns({"voc": F.when(F.col("_has"), F.coalesce("_sung", F.lit(0.0))).otherwise(F.col("voc")),
                              "voc_source": F.when(F.col("_has"), "stem").otherwise(own)}).drop("_has", "_sung")
