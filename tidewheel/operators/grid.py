"""Tempo, beats and bars: candidates, fold search, refinement, grid fit, tempo maps, meters."""

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
from tidewheel.operators.align import lag_sums, peaks, section_of, vertex
from tidewheel.operators.blocks import pack, prefix
from tidewheel.operators.joins import asof_join
from tidewheel.session import arrow_batches, settle


# ---- tempo search
def autocorrelation(onsets: DataFrame, keys: Sequence[str], value: str, lo: int, hi: int,
                    size: int = BLOCK) -> DataFrame:
    """Centred, un-normalised autocorrelation of each series at lags lo..hi."""
    keys = list(keys)
    means = onsets.groupBy(*keys).agg(F.avg(value).alias("_mu"))
    sums = lag_sums(onsets, keys, lo, hi, value, value, size=size).join(means, keys)
    mu = F.col("_mu")
    return sums.select(*keys, "lag", (F.col("sab") - mu * (F.col("sa") + F.col("sb")) + F.col("n") * mu * mu).alias("ac"))


def tempo_candidates(onsets: DataFrame, keys: Sequence[str], value: str, fps: float = C.FPS,
                     lo: float = C.BPM_RANGE[0], hi: float = C.BPM_RANGE[1], keep: int = C.TEMPO_CANDIDATES,
                     size: int = BLOCK) -> DataFrame:
    """The strongest autocorrelation peaks as tempos, then their doubles and halves inside the range,
    de-duplicated within 1.5 % with the first kept: (keys, place, bpm)."""
    keys = list(keys)
    first, last = max(1, int(np.floor(60.0 * fps / hi))), int(np.ceil(60.0 * fps / lo))
    curve = peaks(autocorrelation(onsets, keys, value, first - 1, last + 1, size), keys, "lag", "ac", edges=False)
    inner = curve.where((F.col("lag") >= first) & (F.col("lag") <= last))
    # A series without a peak falls back to its highest lag.
    ranked = inner.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("peak").desc(), F.col("ac").desc(), F.col("lag"))))
    top = ranked.where((F.col("_rank") <= keep) & (F.col("peak") | (F.col("_rank") == 1)))
    shift = F.when(F.col("peak"), vertex(F.col("_left"), F.col("ac"), F.col("_right"))).otherwise(0.0)
    bpm = S.clamp(60.0 * fps / (F.col("lag") + shift), lo, hi)
    listed = top.withColumn("_bpm", bpm).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_bpm"))).alias("_l")).withColumn("_l", F.col("_l._bpm"))
    octaves = F.flatten(F.transform("_l", lambda b: F.array(b * 2.0, b * 0.5)))
    pool = F.concat(F.col("_l"), F.filter(octaves, lambda b: (b >= lo) & (b <= hi)))
    return (listed.withColumn("_pool", dedupe(pool)).select(*keys, F.posexplode("_pool").alias("place", "bpm")))


def dedupe(tempos: Column, tolerance: float = C.COMB_SPAN) -> Column:
    """An array of tempos without those within `tolerance` of one kept earlier."""
    def step(kept, bpm):
        near = F.exists(kept, lambda k: F.abs(bpm - k) <= tolerance * k)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(bpm)))

    return F.aggregate(tempos, F.array().cast("array<double>"), step)


def fold_search(onsets: DataFrame, tempos: DataFrame, keys: Sequence[str], value: str, fps: float = C.FPS,
                size: int = BLOCK) -> DataFrame:
    """Mean onset per beat in every phase bin of every tempo: (keys, bpm, bin, score, phase).

    `tempos` has (keys, bpm). Each block folds its own frames by every tempo of its series in one
    array step; Spark adds the bins up.
    """
    keys = list(keys)
    listed = tempos.select(*keys, "bpm").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("bpm")).alias("_bpms"))
    fold_type = "array<struct<bpm:double,bins:array<double>>>"

    @F.pandas_udf(fold_type)
    def fold(at: pd.Series, v: pd.Series, bpms: pd.Series) -> pd.Series:
        out = []
        for i, x, tempo in zip(at, v, bpms):
            x = np.asarray(x, dtype=np.float64)
            active = x > 0
            where, weight = np.asarray(i, dtype=np.float64)[active], x[active]
            folded = K.fold_all(where, weight, 60.0 * fps / np.asarray(tempo, dtype=np.float64))
            out.append([{"bpm": b, "bins": bins} for b, bins in zip(tempo, folded)])
        return pd.Series(out)

    blocks = pack(onsets, keys, "frame", [value], size).join(listed, keys)
    lengths = onsets.groupBy(*keys).agg(F.count("*").alias("_n"))
    each = blocks.select(*keys, F.explode(fold("frame", value, "_bpms")).alias("_f"))
    bins = each.select(*keys, F.col("_f.bpm").alias("bpm"), F.posexplode("_f.bins").alias("bin", "_w"))
    summed = bins.groupBy(*keys, "bpm", "bin").agg(F.sum("_w").alias("_w")).join(lengths, keys)
    period = 60.0 * fps / F.col("bpm")
    count = F.greatest(F.lit(1.0), F.rint(period))
    return summed.select(*keys, "bpm", "bin", (F.col("_w") * count / F.col("_n")).alias("score"),
                         ((F.col("bin") + 0.5) * period / count).alias("phase"))


def comb_scores(onsets: DataFrame, combs: DataFrame, keys: Sequence[str], value: str, fps: float = C.FPS,
                size: int = BLOCK, blocks: DataFrame | None = None) -> DataFrame:
    """Mean onset under each comb phase + k*period, read between frames: (keys, comb, score).

    `combs` has (keys, comb, bpm, phase), phase in frames; `blocks` may hold the onsets' tempo_blocks().
    """
    keys = list(keys)
    listed = combs.groupBy(*keys).agg(F.collect_list(F.struct("comb", "bpm", "phase")).alias("_combs"))
    sums_type = "array<struct<comb:bigint,s:double,n:double>>"

    @F.pandas_udf(sums_type)
    def sums(blk: pd.Series, at: pd.Series, v: pd.Series, combs_: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for k, i, x, cs, n in zip(blk, at, v, combs_, total):
            start = int(k) * size
            own = min(size, int(n) - start)
            onset = np.nan_to_num(K.dense(i, x, start, own + (1 if start + own < n else 0)))
            groups: dict[float, list] = {}
            for c in cs:
                groups.setdefault(c["bpm"], []).append((c["comb"], c["phase"]))
            rows = []
            for bpm, members in groups.items():
                period = 60.0 * fps / bpm
                phases = np.array([p for _, p in members]) % period
                s, m = K.comb_sums(onset, start, own, int(n), period, phases)
                rows += [{"comb": c, "s": float(a), "n": float(b)} for (c, _), a, b in zip(members, s, m)]
            out.append(rows)
        return pd.Series(out)

    if blocks is None:
        lengths = onsets.groupBy(*keys).agg(F.count("*").alias("_n"))
        blocks = pack(onsets, keys, "frame", [value], size, 0, 1).join(lengths, keys)
    each = blocks.join(listed, keys).select(*keys, F.explode(sums("_blk", "frame", value, "_combs", "_n")).alias("_s")).select(*keys, "_s.*")
    return each.groupBy(*keys, "comb").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1.0))).alias("score"))


def tempo_blocks(onsets: DataFrame, keys: Sequence[str], value: str, size: int = BLOCK) -> DataFrame:
    """One row per block with one frame of the next, for all passes of a tempo search: (keys, _blk, frame, value, _n)."""
    keys = list(keys)
    lengths = onsets.groupBy(*keys).agg(F.count("*").alias("_n"))
    return settle(pack(onsets, keys, "frame", [value], size, 0, 1).join(lengths, keys))


def searched(blocks: DataFrame, starts: DataFrame, keys: Sequence[str], value: str, tally, choose, size: int = BLOCK) -> DataFrame:
    """The best trial around each start (keys, place, bpm, phase): (keys, place, score, bpm, phase).

    `tally(start, onset, first, own, n)` gives a block's sums for all trials of a start, which add up over the blocks of a series;
    `choose(start, n, sums)` is the best trial. No trial is a row: a series of one block is settled where it is tallied, and
    only longer ones have their sums added up, so a task holds one block's trials at a time.
    """
    keys = list(keys)
    listed = starts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "bpm", "phase"))).alias("_starts"))
    wide = blocks.join(listed, keys)
    best_type = "struct<score:double,bpm:double,phase:double>"

    def passes(batches):
        for batch in batches:
            rows, starts_, sums, best = [], [], [], []
            for row in range(batch.num_rows):
                n, first = batch.column("_n")[row].as_py(), batch.column("_blk")[row].as_py() * size
                own = min(size, n - first)
                at, x = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("frame", value))
                onset = np.nan_to_num(K.dense(at, x, first, own + (1 if first + own < n else 0)))
                for start in batch.column("_starts")[row].as_py():
                    found = tally(start, onset, first, own, n)
                    rows.append(row)
                    starts_.append(start)
                    sums.append(None if n <= size else found)
                    best.append(dict(zip(("score", "bpm", "phase"), choose(start, n, found))) if n <= size else None)
            if rows:
                head = batch.select([*keys, "_n"]).take(pa.array(rows))
                columns = [pa.array(starts_, batch.schema.field("_starts").type.value_type), pa.array(sums, pa.list_(pa.float64())),
                           pa.array(best, pa.struct([(c, pa.float64()) for c in ("score", "bpm", "phase")]))]
                yield pa.RecordBatch.from_arrays([*head.columns, *columns], names=[*keys, "_n", "_start", "_sums", "_best"])

    schema = T.StructType([*wide.select(*keys, "_n").schema.fields, T.StructField("_start", wide.schema["_starts"].dataType.elementType),
                           T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_best", T.StructType.fromDDL("score double, bpm double, phase double"))])
    with arrow_batches(blocks.sparkSession, 64):
        done = settle(wide.mapInArrow(passes, schema))

    @F.pandas_udf(best_type)
    def best_of(start: pd.DataFrame, n: pd.Series, sums: pd.Series) -> pd.DataFrame:
        found = [choose(a, int(b), np.asarray(c, dtype=np.float64)) for a, b, c in zip(start.to_dict("records"), n, sums)]
        return pd.DataFrame(found, columns=["score", "bpm", "phase"], dtype=np.float64)

    whole = done.where(F.col("_best").isNotNull()).select(*keys, "_start.place", "_best.*")
    parts = done.where(F.col("_best").isNull()).select(*keys, "_n", "_start", F.posexplode("_sums").alias("_k", "_v"))
    added = parts.groupBy(*keys, "_n", "_start", "_k").agg(F.sum("_v").alias("_v")).groupBy(*keys, "_n", "_start").agg(
        F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_sums"))
    longer = added.select(*keys, "_start.place", best_of("_start", "_n", "_sums._v").alias("_best")).select(*keys, "place", "_best.*")
    return settle(whole.unionByName(longer))


def fold_best(blocks: DataFrame, starts: DataFrame, keys: Sequence[str], value: str, fps: float = C.FPS,
              lo: float = C.BPM_RANGE[0], hi: float = C.BPM_RANGE[1], size: int = BLOCK) -> DataFrame:
    """The tempo within 1.5 % of each start and the phase bin with the highest mean onset a beat (of equals the slowest tempo and first bin)."""
    def tally(start, onset, first, own, n):
        at = np.flatnonzero(onset[:own] > 0)
        tempos = K.bpm_steps(start["bpm"], lo, hi, start["bpm"] * C.COMB_SPAN)
        return np.concatenate(K.fold_all((at + first).astype(np.float64), onset[at], 60.0 * fps / tempos))

    def choose(start, n, sums):
        tempos = K.bpm_steps(start["bpm"], lo, hi, start["bpm"] * C.COMB_SPAN)
        periods = 60.0 * fps / tempos
        counts = np.maximum(1, np.rint(periods)).astype(np.int64)
        row = np.repeat(np.arange(len(tempos)), counts)
        scores = sums * counts[row] / n
        at = K.first_best(scores)
        place = at - int(counts[:row[at]].sum())
        return scores[at], tempos[row[at]], (place + 0.5) * periods[row[at]] / counts[row[at]]

    return searched(blocks, starts, keys, value, tally, choose, size)


def refine(blocks: DataFrame, starts: DataFrame, keys: Sequence[str], value: str, fps: float = C.FPS,
           lo: float = C.BPM_RANGE[0], hi: float = C.BPM_RANGE[1], size: int = BLOCK) -> DataFrame:
    """Polish (keys, place, bpm, phase): tempos within 0.1 BPM, pivoting on the beat nearest the
    middle of the series, that beat moved up to 1.5 frames. Returns (keys, place, score, bpm, phase)."""
    moves = np.arange(31) * 0.1 - 1.5

    def trials(start, n):
        period = 60.0 * fps / start["bpm"]
        middle = start["phase"] + np.rint(((n - 1) / 2.0 - start["phase"]) / period) * period
        tempos = K.bpm_steps(start["bpm"], lo, hi, 0.10)
        return np.repeat(tempos, len(moves)), np.tile(middle + moves, len(tempos))

    def tally(start, onset, first, own, n):
        tempos, phases = trials(start, n)
        periods = 60.0 * fps / tempos
        return np.concatenate(K.comb_sums(onset, first, own, n, periods, phases % periods))

    def choose(start, n, sums):
        tempos, phases = trials(start, n)
        scores = sums[:len(tempos)] / np.maximum(sums[len(tempos):], 1.0)
        at = K.first_best(scores)
        return scores[at], tempos[at], phases[at] % (60.0 * fps / tempos[at])

    return searched(blocks, starts, keys, value, tally, choose, size)


def estimate_tempo(onsets: DataFrame, keys: Sequence[str], value: str, fps: float = C.FPS, lo: float = C.BPM_RANGE[0],
                   hi: float = C.BPM_RANGE[1], size: int = BLOCK) -> DataFrame:
    """The beat grid per series: bpm, beat0, period, score, alt_bpm, alt_score.

    Candidates are weighed with the log-normal tempo prior; a grid whose off-beats carry at least
    85 % of the beats' onset moves up an octave, at most log2(hi/lo) times.
    """
    keys = list(keys)
    pool = settle(tempo_candidates(onsets, keys, value, fps, lo, hi, size=size))
    blocks = tempo_blocks(onsets, keys, value, size)

    def search(centres: DataFrame) -> DataFrame:
        return refine(blocks, fold_best(blocks, centres.withColumn("phase", F.lit(0.0)), keys, value, fps, lo, hi, size), keys, value, fps, lo, hi, size)

    tried = search(pool).withColumn("weighted", F.col("score") * S.tempo_prior(F.col("bpm")))
    order = F.struct("weighted", (-F.col("place")).alias("p"))
    best = settle(tried.groupBy(*keys).agg(F.max_by(F.struct("score", "bpm", "phase"), order).alias("_b")).select(
        *keys, F.lit(0).alias("place"), "_b.*"))
    for _ in range(int(np.floor(np.log2(hi / lo) + 1e-9))):
        period = 60.0 * fps / F.col("bpm")
        off = best.select(*keys, F.lit(0).cast("bigint").alias("comb"), "bpm", (F.col("phase") + period / 2.0).alias("phase"))
        with arrow_batches(onsets.sparkSession, 64):
            off_score = settle(comb_scores(onsets, off, keys, value, fps, size, blocks).select(*keys, F.col("score").alias("_off")))
        doubled = refine(blocks, best.where(F.col("bpm") * 2.0 <= hi + 1e-9).withColumn("bpm", F.col("bpm") * 2.0),
                         keys, value, fps, lo, hi, size).select(*keys, F.struct("score", "bpm", "phase").alias("_d"))
        moves = (F.col("bpm") * 2.0 <= hi + 1e-9) & (F.col("_off") >= C.DOUBLE_EVIDENCE * F.col("score"))
        best = settle(best.join(off_score, keys, "left").join(doubled, keys, "left").withColumn(
            "_g", F.when(moves, F.col("_d")).otherwise(F.struct("score", "bpm", "phase"))).select(*keys, "place", "_g.*"))
    # The octave not taken: one already tried near it, else searched now.
    wanted = best.select(*keys, F.col("bpm").alias("_chosen"), F.col("score").alias("_score"), F.posexplode(
        F.array(F.col("bpm") * 0.5, F.col("bpm") * 2.0)).alias("place", "bpm")).where(
        (F.col("bpm") >= lo * (1 - C.COMB_SPAN)) & (F.col("bpm") <= hi * (1 + C.COMB_SPAN)))
    near = tried.select(*keys, F.col("bpm").alias("_t"), "weighted").join(wanted, keys).where(
        F.abs(F.col("_t") - F.col("bpm")) <= C.COMB_SPAN * F.col("bpm")).groupBy(*keys, "place").agg(
        F.max(F.struct("weighted", F.col("_t").alias("bpm"))).alias("_near"))
    unseen = wanted.join(near, [*keys, "place"], "left_anti").withColumn("bpm", S.clamp(F.col("bpm"), lo, hi))
    fresh = search(unseen.select(*keys, "place", "bpm")).select(*keys, F.struct(
        (F.col("score") * S.tempo_prior(F.col("bpm"))).alias("weighted"), "bpm").alias("_near"))
    alt = near.select(*keys, "_near").unionByName(fresh).groupBy(*keys).agg(F.max("_near").alias("_alt"))
    out = best.join(alt, keys, "left")
    chosen = F.col("score") * S.tempo_prior(F.col("bpm"))
    period_s, start = 60.0 / F.col("bpm"), F.col("phase") / fps
    return out.select(
        *keys, "bpm", F.when(period_s - start < 1.0 / fps, 0.0).otherwise(start).alias("beat0"), period_s.alias("period"),
        "score", F.when(chosen > 0, F.col("_alt.bpm")).alias("alt_bpm"),
        F.when(chosen > 0, F.col("_alt.weighted") / chosen).alias("alt_score"))


def beat_rows(grids: DataFrame, keys: Sequence[str], beat0: Column, period: Column, dur: Column,
              size: int = BLOCK) -> DataFrame:
    """Every grid beat in [0, dur): (keys, idx, t)."""
    from tidewheel.operators.joins import spread_index

    count = F.when(dur > beat0, F.ceil((dur - beat0) / period)).otherwise(0).cast("bigint")
    placed = grids.select(*keys, beat0.alias("_b0"), period.alias("_p"), count.alias("_c"))
    rows = spread_index(placed.select(*keys, F.col("_c")), keys, "_c", "idx", size)
    return rows.join(placed, list(keys)).select(*keys, "idx", (F.col("_b0") + F.col("idx") * F.col("_p")).alias("t"))


# ---- how well a grid fits
def grid_fit(onsets: DataFrame, beats: DataFrame, keys: Sequence[str], value: str, per_bar: int = 4,
             fps: float = C.FPS, tolerance: float = C.TOLERANCE_S) -> DataFrame:
    """How far the pulse sits from the grid, one 8-bar section at a time.

    `beats` has (keys, t, bar). A section's onsets and beats are a bounded slice, fitted as one row:
    start, end, beats, offset_ms, max_ms, bpm, off (NULLs where no pulse stands out).
    """
    from tidewheel.operators.joins import interval_join

    keys = list(keys)
    sect = [*keys, "section"]
    members = beats.withColumn("section", section_of(F.col("bar")))
    sections = members.groupBy(*sect).agg(F.array_sort(F.collect_list("t")).alias("_beats"),
                                          F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))
    gaps = F.zip_with(F.slice("_beats", 2, F.size("_beats")), F.slice("_beats", 1, F.greatest(
        F.size("_beats") - 1, F.lit(0))), lambda b, a: b - a)
    ordered = F.array_sort(gaps)
    half = F.size(gaps)
    middle = F.when(half > 0, (F.element_at(ordered, F.floor((half + 1) / 2).cast("int"))
                               + F.element_at(ordered, F.floor(half / 2).cast("int") + 1)) / 2.0)
    sections = sections.withColumn("_own", middle).withColumn(
        "_lo", F.greatest(F.lit(0), F.floor((F.col("_beats")[0] - F.col("_own") / 2.0) * fps)).cast("double")).withColumn(
        "_hi", (F.ceil((F.element_at("_beats", -1) + F.col("_own") / 2.0) * fps) + 1).cast("double"))
    usable = sections.where(F.size("_beats") >= 2 * per_bar)
    width = 4096.0
    slices = interval_join(onsets.select(*keys, "frame", value), usable.select(*sect, "_lo", "_hi"), keys, "frame",
                           "_lo", "_hi", width).groupBy(*sect).agg(
        F.array_sort(F.collect_list(F.struct("frame", value))).alias("_rows"))
    fit_type = "struct<stretch:double,shift:double,worst:double,off:bigint>"

    @F.pandas_udf(fit_type)
    def fit(at: pd.Series, v: pd.Series, beats_: pd.Series) -> pd.DataFrame:
        rows = []
        for i, x, b in zip(at, v, beats_):
            rows.append(K.section_fit(np.asarray(x, dtype=np.float64), int(i[0]), np.asarray(b, dtype=np.float64), fps,
                                      C.PULSE_CONTRAST, tolerance) or (None,) * 4)
        return pd.DataFrame(rows, columns=["stretch", "shift", "worst", "off"]).astype({"off": "Int64"})

    fitted = usable.join(slices, sect).select(*sect, fit("_rows.frame", f"_rows.{value}", "_beats").alias("_fit"))
    return sections.join(fitted, sect, "left").select(
        *sect, "first_bar", "last_bar", F.round(F.greatest(F.lit(0.0), F.col("_beats")[0]), 3).alias("start"),
        F.round(F.element_at("_beats", -1) + F.coalesce("_own", F.lit(0.0)), 3).alias("end"), F.size("_beats").alias("beats"),
        F.rint(F.col("_fit.shift") * 1000).alias("offset_ms"), F.rint(F.col("_fit.worst") * 1000).alias("max_ms"),
        F.round(60.0 / F.col("_own") / F.col("_fit.stretch"), 2).alias("bpm"), F.col("_fit.off").alias("off"))


def grid_findings(tempos: DataFrame, fits: DataFrame, downbeats: DataFrame, keys: Sequence[str],
                  lo: float = C.BPM_RANGE[0], hi: float = C.BPM_RANGE[1]) -> DataFrame:
    """What to double-check before trusting a grid, as findings (keys, level, rule, message)."""
    keys = list(keys)
    measured = fits.where(F.col("off").isNotNull()).groupBy(*keys).agg(
        F.sum("off").alias("_off"), F.sum("beats").alias("_beats"), F.max("max_ms").alias("_worst"))
    all_ = tempos.join(measured, keys, "left").join(downbeats.select(*keys, "confidence"), keys, "left")
    low, high = S.octave_range(F.col("alt_bpm"), lo, hi)
    octave = F.when(F.col("alt_score") >= C.OCTAVE_CLOSE, F.format_string(
        "%.2f BPM scores %.2f of the chosen %.2f; search %.0f to %.0f to prefer it", "alt_bpm", "alt_score", "bpm", low, high))
    drift = F.when(F.col("_off") > 0, F.format_string(
        "%d of %d beats sit off the grid, the worst by %.0f ms", "_off", "_beats", F.col("_worst").cast("double")))
    guess = F.when(F.col("confidence") < C.DOWNBEAT_SURE, F.format_string(
        "bar 1 is a guess (confidence %.2f)", "confidence"))
    rows = F.array(*[F.struct(F.lit("warn").alias("level"), F.lit(rule).alias("rule"), text.alias("message"))
                     for rule, text in (("octave", octave), ("drift", drift), ("downbeat", guess))])
    return all_.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*").where(F.col("message").isNotNull())


# ---- tempo maps and meters
def tempo_map(changes: DataFrame, keys: Sequence[str], tick: str, micros: str, ppq: float | None = None, size: int = BLOCK,
              smpte: tuple[float, int] | None = None) -> DataFrame:
    """Tempo changes as (keys, tick, quarters, seconds, bpm); 120 BPM until the first change.

    With `ppq` ticks are parts of a quarter note, and seconds accumulate at the tempo before. With `smpte` (frames a second, ticks a
    frame) ticks are parts of a second, and quarter notes accumulate.
    """
    if (ppq is None) == (smpte is None):
        raise ValueError("a tempo map has either ppq or smpte")
    keys = list(keys)
    rows = changes.select(*keys, F.col(tick).cast("bigint").alias("tick"), F.col(micros).cast("double").alias("_us"))
    heads = rows.groupBy(*keys).agg(F.min("tick").alias("_first")).where(F.col("_first") > 0).select(
        *keys, F.lit(0).cast("bigint").alias("tick"), F.lit(float(C.DEFAULT_TEMPO_US)).alias("_us"))
    from tidewheel.operators.series import previous_row

    linked = previous_row(rows.unionByName(heads).withColumn("_pair", F.struct("tick", "_us")), keys, "tick", "_pair", "_prev", size)
    ticks = F.col("tick") - F.col("_prev.tick")
    step = ticks * F.col("_prev._us") / (ppq * 1e6) if smpte is None else ticks / (smpte[0] * smpte[1]) * 1e6 / F.col("_prev._us")
    summed = prefix(linked.withColumn("_step", F.coalesce(step, F.lit(0.0))), keys, {"_sum": ("sum", "_step")}, index="tick", size=size)
    even = F.col("tick") / (ppq if smpte is None else smpte[0] * smpte[1])
    quarters, seconds = (even, F.col("_sum")) if smpte is None else (F.col("_sum"), even)
    return summed.select(*keys, "tick", quarters.alias("quarters"), seconds.alias("seconds"), (60e6 / F.col("_us")).alias("bpm"))


def seconds_at(points: DataFrame, tempos: DataFrame, keys: Sequence[str], quarters: str, out: str = "seconds",
               bucket: float = 4096.0) -> DataFrame:
    """Seconds of quarter positions through a tempo map; both ends extrapolate."""
    return _through(points, tempos, keys, quarters, "quarters", "seconds", out, bucket,
                    lambda at, q, s, bpm: s + (at - q) * 60.0 / bpm)


def quarters_at(points: DataFrame, tempos: DataFrame, keys: Sequence[str], seconds: str, out: str = "quarters",
                bucket: float = 3600.0) -> DataFrame:
    """Quarter positions of seconds through a tempo map; both ends extrapolate."""
    return _through(points, tempos, keys, seconds, "seconds", "quarters", out, bucket,
                    lambda at, s, q, bpm: q + (at - s) * bpm / 60.0)


def _through(points, tempos, keys, at, source, target, out, bucket, rule):
    keys = list(keys)
    map_ = tempos.select(*keys, F.col(source).alias("_src"), F.struct(F.col(source).alias("s"), F.col(target).alias("d"), "bpm").alias("_e"))
    hit = asof_join(points, map_, keys, at, "_src", ["_e"], 0.0, bucket)
    first = tempos.groupBy(*keys).agg(F.min_by(F.struct(F.col(source).alias("s"), F.col(target).alias("d"), "bpm"), source).alias("_f"))
    joined = hit.join(first, keys, "left").withColumn("_e", F.coalesce("_e", "_f"))
    return joined.withColumn(out, rule(F.col(at), F.col("_e.s"), F.col("_e.d"), F.col("_e.bpm"))).drop("_e", "_f")


def bar_lines(meters: DataFrame, spans: DataFrame, keys: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Every bar that overlaps [q_from, q_to]: (keys, bar, q, length, num, den, pulse).

    `meters` (keys, q, num, den, pulse) in quarter notes, `spans` (keys, q_from, q_to, anchor). Bar 1
    starts at the anchor, a meter arriving mid-bar starts a new bar, bars before bar 1 are
    extrapolated at its meter and numbered 0, -1, ...
    """
    from tidewheel.operators.series import previous_row

    keys = list(keys)
    head_at = meters.join(spans, keys).where(F.col("q") <= F.col("anchor") + 1e-9).groupBy(*keys).agg(
        F.max_by(F.struct("num", "den", "pulse"), "q").alias("_m"))
    earliest = meters.groupBy(*keys).agg(F.min_by(F.struct("num", "den", "pulse"), "q").alias("_m0"))
    heads = spans.join(head_at, keys, "left").join(earliest, keys).withColumn("_m", F.coalesce("_m", "_m0"))
    start = heads.select(*keys, F.col("anchor").alias("q"), "_m.*")
    later = meters.join(spans.select(*keys, "anchor"), keys).where(F.col("q") > F.col("anchor") + 1e-9).select(
        *keys, "q", "num", "den", "pulse")
    segments = start.unionByName(later).withColumn("_u", F.floor(F.col("q") * 960).cast("bigint"))
    # The next segment's start, through the order reversed.
    segments = settle(segments)
    flipped = previous_row(segments.withColumn("_neg", -F.col("_u")).withColumn("_q", F.col("q")), keys, "_neg", "_q", "_next", size * 960)
    placed = flipped.join(spans, keys).withColumn("_len", F.col("num") * 4.0 / F.col("den"))
    whole = F.when(F.col("_next").isNull(), F.floor((F.col("q_to") - F.col("q")) / F.col("_len") + 1e-9) + 1).otherwise(
        F.ceil((F.col("_next") - F.col("q")) / F.col("_len") - 1e-9))
    counted = placed.withColumn("_bars", F.greatest(whole, F.lit(0)).cast("bigint"))
    numbered = prefix(settle(counted), keys, {"_through": ("sum", "_bars")}, index="_u", size=size * 960)
    first = F.greatest(F.lit(0), F.floor((F.col("q_from") - F.col("q")) / F.col("_len") + 1e-9)).cast("bigint")
    last = F.least(F.col("_bars") - 1, F.floor((F.col("q_to") - F.col("q")) / F.col("_len") + 1e-9).cast("bigint"))
    after = numbered.withColumn("_k0", first).withColumn("_k1", last).where(F.col("_k0") <= F.col("_k1")).withColumn(
        "_k", F.explode(F.sequence("_k0", "_k1")))
    q = F.col("q") + F.col("_k") * F.col("_len")
    ends = F.least(q + F.col("_len"), F.coalesce("_next", q + F.col("_len")))
    after = after.select(*keys, (F.col("_through") - F.col("_bars") + F.col("_k") + 1).cast("bigint").alias("bar"), q.alias("q"),
                         (ends - q).alias("length"), "num", "den", "pulse", "q_from", "q_to")
    lead = heads.withColumn("_len", F.col("_m.num") * 4.0 / F.col("_m.den"))
    most = F.ceil((F.col("anchor") - F.col("q_from")) / F.col("_len") - 1e-9).cast("bigint")
    before = lead.withColumn("_n", most).where(F.col("_n") >= 1).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    before = before.select(*keys, (1 - F.col("_k")).alias("bar"), (F.col("anchor") - F.col("_k") * F.col("_len")).alias("q"),
                           F.col("_len").alias("length"), "_m.num", "_m.den", "_m.pulse", "q_from", "q_to")
    return after.unionByName(before).where(
        (F.col("q") <= F.col("q_to") + 1e-9) & (F.col("q") + F.col("length") > F.col("q_from") + 1e-9)).drop("q_from", "q_to")


def bar_steps(bars: DataFrame, keys: Sequence[str], step: Column) -> DataFrame:
    """Steps from each bar line on, the bar's last cut short by the next bar: (keys, bar, q)."""
    count = F.ceil(F.col("length") / step - 1e-9).cast("bigint")
    rows = bars.withColumn("_step", step).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    return rows.select(*keys, "bar", (F.col("q") + F.col("_k") * F.col("_step")).alias("q"))


def inside_song(points: DataFrame, keys: Sequence[str], t: str, dur: str) -> DataFrame:
    """Grid points in [0, dur); one a hair before 0 is at 0."""
    at = F.col(t)
    return points.where((at >= -C.EDGE_S) & (at < F.col(dur))).withColumn(t, F.greatest(at, F.lit(0.0)))


def session_grid(meters: DataFrame, tempos: DataFrame, songs: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """The session's grid on a song: beats, pulses, bars, summary, tempo changes and time signatures.

    `songs` has (keys, offset, dur, downbeat): song time = session time + offset, downbeat NULL when
    tick 0 is bar 1. The last two start with what is in effect at 0 and list what changes after it.
    """
    from tidewheel.operators.series import previous_row

    keys = list(keys)
    ends = songs.select(*keys, (-F.col("offset") - C.EDGE_S).alias("_a"), (F.col("dur") - F.col("offset")).alias("_b"),
                        F.coalesce(F.col("downbeat") - F.col("offset"), F.lit(0.0)).alias("_c"), "downbeat")
    spans = settle(quarters_at(settle(ends), tempos, keys, "_a", "q_from"))
    spans = settle(quarters_at(spans, tempos, keys, "_b", "q_to"))
    spans = quarters_at(spans, tempos, keys, "_c", "_anchor").withColumn(
        "anchor", F.when(F.col("downbeat").isNull(), 0.0).otherwise(F.col("_anchor"))).select(*keys, "q_from", "q_to", "anchor")
    lines = settle(bar_lines(meters, settle(spans), keys))

    def on_song(rows: DataFrame) -> DataFrame:
        timed = seconds_at(rows, tempos, keys, "q", "t").join(songs.select(*keys, "offset", "dur"), keys)
        return inside_song(timed.withColumn("t", F.col("t") + F.col("offset")), keys, "t", "dur").drop("offset", "dur")

    beats = on_song(bar_steps(lines, keys, F.lit(1.0)))
    pulses = on_song(bar_steps(lines, keys, F.col("pulse")))
    bars = on_song(lines)
    real = bars.where(F.col("bar") >= 1).groupBy(*keys).agg(F.min(F.struct("t", "bar", "num", "den", "pulse")).alias("_r"))
    shifted = tempos.join(songs.select(*keys, "offset", "dur"), keys).withColumn("t", F.col("seconds") + F.col("offset"))
    at_bar1 = asof_join(real.select(*keys, F.col("_r.t").alias("_t"), "_r"), shifted.select(*keys, "t", "bpm"), keys, "_t", "t", ["bpm"], 1e-9)
    summary = at_bar1.select(*keys, F.col("_r.t").alias("downbeat"), F.col("_r.bar").alias("downbeat_bar"),
                             F.coalesce("bpm", F.lit(60e6 / C.DEFAULT_TEMPO_US)).alias("bpm"),
                             F.rint(S.quarters_per_bar(F.col("_r.num"), F.col("_r.den")) / F.col("_r.pulse")).cast("int").alias("pulses_per_bar"))
    starts = songs.select(*keys, (-F.col("offset")).alias("_zero"))
    default = F.lit(60e6 / C.DEFAULT_TEMPO_US)
    at_zero = asof_join(starts, tempos.select(*keys, "seconds", "bpm"), keys, "_zero", "seconds", ["bpm"], 0.0)
    first_bpm = tempos.groupBy(*keys).agg(F.min_by("bpm", "tick").alias("_first"))
    head = at_zero.join(first_bpm, keys, "left").select(*keys, F.lit(0.0).alias("t"), F.coalesce("bpm", "_first", default).alias("bpm"))
    linked = previous_row(shifted.select(*keys, "tick", "t", "dur", "bpm"), keys, "tick", "bpm", "_before")
    changed = linked.where((F.col("t") > 0) & (F.col("t") < F.col("dur")) & F.coalesce(F.abs(F.col("bpm") - F.col("_before")) > 1e-6, F.lit(True)))
    tempo_changes = head.unionByName(changed.select(*keys, "t", "bpm"))
    # The signature in effect at 0 is that of the bar that 0 falls in, or of the first there is.
    meter = F.struct("num", "den")
    zero_q = quarters_at(starts, tempos, keys, "_zero", "_q")
    signed = lines.withColumn("_m", meter)
    first_line = signed.groupBy(*keys).agg(F.min_by("_m", "q").alias("_first"))
    opening = asof_join(zero_q, signed.select(*keys, "q", "_m"), keys, "_q", "q", ["_m"], 1e-9).join(first_line, keys).withColumn("_m", F.coalesce("_m", "_first"))
    earlier = previous_row(signed.select(*keys, "bar", "_m"), keys, "bar", "_m", "_before").select(*keys, "bar", "_before")
    later = on_song(signed).join(earlier, [*keys, "bar"]).where((F.col("t") > 0) & ~F.col("_m").eqNullSafe(F.coalesce("_before", "_m")))
    signatures = opening.select(*keys, F.lit(0.0).alias("t"), "_m.*").unionByName(later.select(*keys, "t", "_m.*"))
    return {"beats": beats, "pulses": pulses, "bars": bars, "summary": summary, "tempo_changes": tempo_changes, "time_signatures": signatures}
