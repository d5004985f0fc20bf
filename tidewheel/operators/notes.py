"""Notes: pairing, sustain, tracks, clusters, chords, and aligning note onsets with a series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel import constants as C
from tidewheel.constants import BLOCK
from tidewheel.functions import kernels as K
from tidewheel.functions.chords import chord_name
from tidewheel.operators.align import best_and_runner_up, lag_sums
from tidewheel.operators.blocks import halo, join_keys, neighbour, number_rows, pack, prefix
from tidewheel.operators.grid import quarters_at, seconds_at
from tidewheel.operators.joins import asof_join, changes, interval_join
from tidewheel.session import arrow_batches, settle

# Words that name a drum track.
DRUM_WORDS = (
    r"\b(drums?|drummer|kit|kick|bd|snare|sd|hats?|hihats?|hi hats?|hh|claps?|perc|percussion|rim|rimshot|toms?|"
    r"cymbals?|crash|ride|shaker|tamb|tambourine|conga|bongo|cowbell|clave)\b")


# ---- pairing
def pair_notes(events: DataFrame, keys: Sequence[str], size: int = BLOCK) -> DataFrame:
    """On/off events as notes, first in first out per channel and pitch.

    `events` has seq (the stream's order), tick, kind (on, off, pedal), channel, pitch, value. An on
    at value 0 is an off; an off with nothing open does nothing; an on never closed ends with its
    track (`closed` false). The open count before an event is the running sum's height above its
    lowest point so far, so the k-th on pairs with the k-th off that found something open.
    """
    keys = list(keys)
    voice = [*keys, "channel", "pitch"]
    ends = events.groupBy(*keys).agg(F.max("tick").alias("_track_end"))
    on = (F.col("kind") == "on") & (F.col("value") > 0)
    steps = events.where(F.col("kind").isin("on", "off")).select(
        *voice, "seq", "tick", "value", on.alias("_on"), F.when(on, 1).otherwise(-1).alias("_d"))
    summed = settle(prefix(steps, voice, {"_s": ("sum", "_d")}, index="seq", size=size).withColumn(
        "_before", F.col("_s") - F.col("_d")))
    lowest = prefix(summed, voice, {"_low": ("min", "_before")}, index="seq", size=size)
    used = settle(lowest.withColumn("_open", F.col("_before") - F.col("_low")).where(F.col("_on") | (F.col("_open") > 0)))
    ranked = prefix(used.withColumn("_off", F.when(~F.col("_on"), 1)).withColumn("_start", F.when(F.col("_on"), 1)), voice,
                    {"_ko": ("count", "_start"), "_kf": ("count", "_off")}, index="seq", size=size)
    ranked = settle(ranked)
    starts = ranked.where("_on").select(*voice, F.col("_ko").alias("_k"), F.col("seq").alias("on_seq"), F.col("tick").alias("on_tick"),
                                        F.col("value").alias("velocity"))
    stops = ranked.where(~F.col("_on")).select(*voice, F.col("_kf").alias("_k"), F.col("seq").alias("off_seq"), F.col("tick").alias("off_tick"))
    return (starts.join(stops, [*voice, "_k"], "left").join(ends, keys).withColumn("closed", F.col("off_tick").isNotNull())
            .withColumn("off_tick", F.coalesce("off_tick", "_track_end")).drop("_k").withColumnRenamed("_track_end", "track_end"))


def sustain(notes: DataFrame, events: DataFrame, keys: Sequence[str], bucket: float = float(BLOCK)) -> DataFrame:
    """Notes released while the pedal is down end at pedal-up, at the same pitch's next on, or with
    the track: adds `end_tick`."""
    keys = list(keys)
    pedals = events.where(F.col("kind") == "pedal").select(*keys, "channel", F.col("seq").alias("_seq"), (F.col("value") >= 64).alias("_down"))
    ups = events.where((F.col("kind") == "pedal") & (F.col("value") < 64)).select(
        *keys, "channel", F.col("seq").alias("_seq"), F.col("tick").alias("_up"))
    ons = events.where((F.col("kind") == "on") & (F.col("value") > 0)).select(
        *keys, "channel", "pitch", F.col("seq").alias("_seq"), F.col("tick").alias("_again"))
    released = notes.where("closed")
    held = asof_join(released, pedals, [*keys, "channel"], "off_seq", "_seq", ["_down"], 0.0, bucket)
    held = settle(held.where(F.coalesce("_down", F.lit(False))).drop("_down"))
    held = asof_join(held, ups, [*keys, "channel"], "off_seq", "_seq", ["_up"], 0.0, bucket, forward=True)
    held = asof_join(settle(held), ons, [*keys, "channel", "pitch"], "off_seq", "_seq", ["_again"], 0.0, bucket, forward=True, strict=True)
    end = F.least(F.coalesce("_up", "track_end"), F.coalesce("_again", "track_end"))
    longer = held.select(*keys, "on_seq", end.alias("_end"))
    return notes.join(longer, [*keys, "on_seq"], "left").withColumn("end_tick", F.coalesce("_end", "off_tick")).drop("_end")


# ---- tracks
def merge_changes(rows: DataFrame, keys: Sequence[str], tick: str, track: str, values: Sequence[str]) -> DataFrame:
    """Tempo or meter changes of all tracks: at one tick the later track's wins."""
    return rows.groupBy(*keys, tick).agg(F.max_by(F.struct(*values), track).alias("_v")).select(*keys, tick, "_v.*")


def key_signature(rows: DataFrame, keys: Sequence[str], tick: str, track: str, value: str) -> DataFrame:
    """The earliest key signature; file order breaks ties. Rows without a tick take no part."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.when(F.col(tick).isNotNull(), F.struct(tick, track))).alias("key_signature"))


def drum_named(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(name), r"[_\-.]+", " ").rlike(DRUM_WORDS), F.lit(False))


def label_tracks(notes: DataFrame, names: DataFrame, keys: Sequence[str], split: bool = False) -> DataFrame:
    """One row per track with notes: label, slug, drum flag. `split` (format 0) makes one per channel.

    `names` has (keys, track, name, instrument).
    """
    from tidewheel.functions.text import slug, unique_suffixes

    keys = list(keys)
    by = [*keys, "track", "channel"] if split else [*keys, "track"]
    grouped = notes.groupBy(*by).agg(F.max((F.col("channel") == C.DRUM_CHANNEL).cast("int")).alias("_drum"))
    if split:
        listed = grouped.withColumn("name", F.lit(None).cast("string")).withColumn("number", F.col("channel") + 1).withColumn(
            "_fallback", F.concat(F.lit("channel-"), (F.col("channel") + 1).cast("string")))
    else:
        named = names.select(*keys, "track", F.coalesce("name", "instrument").alias("name"))
        listed = grouped.join(named, [*keys, "track"], "left").withColumn("number", F.col("track")).withColumn(
            "_fallback", F.concat(F.lit("track-"), F.col("track").cast("string")))
    base = F.nullif(slug(F.coalesce("name", F.lit(""))), F.lit(""))
    rows = listed.select(*by, "name", "number", F.coalesce("name", "_fallback").alias("label"), F.coalesce(base, "_fallback").alias("_base"),
                         ((F.col("_drum") == 1) | drum_named(F.col("name"))).alias("drum_like"))
    return unique_suffixes(settle(rows), keys, "_base", "number", "slug").drop("_base")


def emit_events(notes: DataFrame, songs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(event rows on the song's clock, dropped counts): t, strength, dur, pitch; notes outside are dropped."""
    keys = list(keys)
    placed = notes.join(songs.select(*keys, "offset", F.col("dur").alias("_song")), keys).withColumn("_t", F.col("t") + F.col("offset"))
    inside = (F.col("_t") >= -C.EDGE_S) & (F.col("_t") < F.col("_song"))
    rows = placed.where(inside).select(*[c for c in notes.columns if c not in ("t", "velocity", "dur")],
                                       F.round(F.greatest("_t", F.lit(0.0)), 4).alias("t"), F.round(F.col("velocity") / 127.0, 3).alias("strength"),
                                       F.round("dur", 4).alias("dur"))
    dropped = placed.groupBy(*keys).agg(F.count_if(~inside).alias("dropped"), F.count("*").alias("notes"))
    return rows, dropped


# ---- clusters
def onset_clusters(notes: DataFrame, keys: Sequence[str], width: float, inclusive: bool, t: str = "t",
                   bucket: float = 64.0, size: int = BLOCK) -> DataFrame:
    """Adds `cluster`: the time of the first note of each note's onset cluster.

    A cluster is anchored on its first note, not chained. Each block of a key's distinct times is summed up
    by where an anchor carried into it comes out: a few (last entry, last anchor) steps, since clusters that start
    anywhere soon fall together. Only these summaries are followed from block to block; then every block
    places its own clusters. A key of any size is so spread over tasks.
    """
    keys = list(keys)
    times = number_rows(notes.select(*keys, t).distinct(), keys, [t], F.floor(F.col(t) / bucket).cast("bigint"), "_n")
    blocks = settle(pack(times.withColumn("_n", F.col("_n") - 1), keys, "_n", [t], size).select(*keys, "_blk", F.col(t).alias("_at")))

    @F.pandas_udf("array<struct<upto:double,anchor:double>>")
    def steps(at: pd.Series) -> pd.Series:
        return at.map(lambda x: [{"upto": u, "anchor": v} for u, v in K.anchor_steps(np.asarray(x), width, inclusive)])

    def follow(summaries: pd.DataFrame) -> pd.DataFrame:
        summaries = summaries.sort_values("_blk")
        held, carried = None, []
        for block in summaries["_steps"]:
            carried.append(held)
            held = next((s["anchor"] for s in block if K.starts_anew(s["upto"], held, width, inclusive)), held)
        return summaries.drop(columns="_steps").assign(_held=np.array(carried, dtype="float64"))

    fields = T.StructType([*[f for f in blocks.schema.fields if f.name in [*keys, "_blk"]], T.StructField("_held", T.DoubleType())])
    held = blocks.select(*keys, "_blk", steps("_at").alias("_steps")).groupBy(*keys).applyInPandas(follow, fields)

    @F.pandas_udf("array<double>")
    def place(at: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([K.anchors(np.asarray(x), None if np.isnan(h) else h, width, inclusive) for x, h in zip(at, before)])

    placed = join_keys(blocks, held, [*keys, "_blk"])
    each = placed.select(*keys, F.explode(F.arrays_zip(F.col("_at").alias("t"), place("_at", "_held").alias("c"))).alias("_x")).select(
        *keys, F.col("_x.t").alias(t), F.col("_x.c").alias("cluster"))
    return join_keys(notes, each, [*keys, t])


def onset_impulses(notes: DataFrame, keys: Sequence[str], drum: str = "drum_like", cluster: float = C.ONSET_CLUSTER_S) -> DataFrame:
    """Weighted onsets: a cluster counts once at its loudest, drums double: (keys, t, weight)."""
    weight = F.col("velocity") / 127.0 * F.when(F.col(drum), C.DRUM_WEIGHT).otherwise(1.0)
    grouped = onset_clusters(notes.withColumn("_w", weight), keys, cluster, True)
    return grouped.groupBy(*keys, "cluster").agg(F.max("_w").alias("weight")).select(*keys, F.col("cluster").alias("t"), "weight")


def merge_intervals(spans: DataFrame, keys: Sequence[str], start: str, end: str, bucket: float = 64.0) -> DataFrame:
    """Overlapping intervals of a key as their union."""
    keys = list(keys)
    numbered = settle(number_rows(spans.select(*keys, start, end), keys, [start, end], F.floor(F.col(start) / bucket).cast("bigint"), "_n"))
    reach = settle(prefix(numbered, keys, {"_reach": ("max", end)}, index="_n"))
    linked = neighbour(reach, keys, "_n", {"_before": ("_reach", -1)})
    opened = linked.withColumn("_open", F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), F.col(start)))
    named = prefix(settle(opened), keys, {"_run": ("max", "_open")}, index="_n")
    return named.groupBy(*keys, "_run").agg(F.max(end).alias(end)).select(*keys, F.col("_run").alias(start), end)


def sounding_clusters(notes: DataFrame, keys: Sequence[str], cluster: float = C.CHORD_CLUSTER_S, bucket: float = 4.0) -> DataFrame:
    """Every onset cluster with the pitches sounding there: (keys, t, pitches sorted).

    Besides its own notes, an earlier note still sounding `cluster` into it counts. Held notes are
    first merged per pitch, so a cluster meets each pitch once however many notes hold it.
    """
    keys = list(keys)
    placed = settle(onset_clusters(notes.select(*keys, "t", "dur", "pitch"), keys, cluster, False))
    own = placed.select(*keys, F.col("cluster").alias("_c"), "pitch")
    starts = own.select(*keys, "_c").distinct()
    spans = placed.select(*keys, "pitch", (F.col("cluster") + 1e-9).alias("_from"), (F.col("t") + F.col("dur") - cluster).alias("_to"))
    held = merge_intervals(spans.where(F.col("_to") > F.col("_from")), [*keys, "pitch"], "_from", "_to")
    still = interval_join(starts, held, keys, "_c", "_from", "_to", bucket).select(*keys, "_c", "pitch")
    return own.unionByName(still).groupBy(*keys, F.col("_c").alias("t")).agg(F.array_sort(F.collect_set("pitch")).alias("pitches"))


# ---- chords
def named_clusters(clusters: DataFrame, keys: Sequence[str], signatures: DataFrame | None = None) -> DataFrame:
    """Clusters with their pitch-class set and chord name (NULL: no chord)."""
    from tidewheel.functions.chords import class_mask

    keyed = clusters if signatures is None else clusters.join(signatures, list(set(keys) & set(signatures.columns)), "left")
    key = F.col("key_signature") if signatures is not None else F.lit(None).cast("int")
    return keyed.withColumn("mask", class_mask(F.col("pitches"))).withColumn("chord", chord_name(F.col("pitches"), key)).select(
        *keys, "t", "pitches", "mask", "chord")


def harmonic_tracks(named: DataFrame, keys: Sequence[str], drums: DataFrame | None = None) -> DataFrame:
    """Tracks that play chords: at least two, and on a fifth of their clusters; drums never do."""
    out = named.groupBy(*keys).agg(F.count("chord").alias("chords"), F.count("*").alias("clusters")).where(
        (F.col("chords") >= 2) & (F.col("chords") >= C.POLYPHONIC_SHARE * F.col("clusters")))
    return out if drums is None else out.join(drums.where("drum_like").select(*keys), list(keys), "left_anti")


def chord_changes(named: DataFrame, notes: DataFrame, tempos: DataFrame, keys: Sequence[str], map_keys: Sequence[str],
                  bucket: float = 64.0) -> DataFrame:
    """Chord changes: (keys, t, until, chord). A segment of equal sets counts when it is a chord, holds
    an eighth note and differs from the last change; it lasts until the next one, or the last note's end."""
    keys = list(keys)
    ends = notes.groupBy(*keys).agg(F.max(F.col("t") + F.col("dur")).alias("_end"))
    block = F.floor(F.col("t") / bucket).cast("bigint")
    indexed = settle(number_rows(named, keys, ["t"], block, "_n"))
    segments = settle(changes(indexed, keys, "_n", ["mask"]))
    order = settle(number_rows(segments.drop("_n"), keys, ["t"], block, "_n"))
    linked = neighbour(order, keys, "_n", {"_next": ("t", 1)}).join(ends, keys).withColumn("_until", F.coalesce("_next", "_end"))
    at = quarters_at(settle(linked.where(F.col("chord").isNotNull())), tempos, map_keys, "t", "_q").withColumn("_q", F.col("_q") + 0.5)
    timed = seconds_at(settle(at), tempos, map_keys, "_q", "_eighth")
    long = timed.where(F.col("_until") - F.col("t") >= F.col("_eighth") - F.col("t") - 1e-9)
    kept = settle(number_rows(settle(long.select(*keys, "t", "mask", "chord", "_end")), keys, ["t"], block, "_n"))
    emitted = changes(kept, keys, "_n", ["mask"]).drop("_n")
    last = settle(number_rows(settle(emitted), keys, ["t"], block, "_n"))
    return neighbour(last, keys, "_n", {"_then": ("t", 1)}).select(*keys, "t", F.coalesce("_then", "_end").alias("until"), "chord")


def chord_rows(chords: DataFrame, songs: DataFrame, keys: Sequence[str], map_keys: Sequence[str]) -> DataFrame:
    """Changes on the song's clock: the chord already sounding at the start is at 0."""
    placed = chords.join(songs.select(*map_keys, "offset", F.col("dur").alias("_song")), list(map_keys))
    t = F.col("t") + F.col("offset")
    return placed.where((t < F.col("_song")) & (F.col("until") + F.col("offset") > 0)).select(
        *keys, F.round(F.greatest(t, F.lit(0.0)), 4).alias("t"), "chord")


# ---- aligning onsets with a series
def impulse_train(impulses: DataFrame, keys: Sequence[str], fps: float, shift: Column | None = None) -> DataFrame:
    """Impulses on a frame grid: each split between its two frames, then a 3-frame box."""
    at = F.col("t") * fps + (shift if shift is not None else 0.0)
    base = F.floor(at).cast("bigint")
    part = at - F.floor(at)
    shares = F.array(*[F.struct((base + k).alias("frame"), (F.col("weight") * share / 3.0).alias("v"))
                       for k, share in ((-1, 1 - part), (0, 1 - part), (1, 1 - part), (0, part), (1, part), (2, part))])
    return impulses.select(*keys, F.explode(shares).alias("_s")).groupBy(*keys, F.col("_s.frame").alias("frame")).agg(
        F.sum("_s.v").alias("train"))


def shifted_moments(impulses: DataFrame, heard: DataFrame, keys: Sequence[str], steps: int, per: int, size: int = BLOCK) -> DataFrame:
    """The train of impulses (at, in frames, and weight) moved by step / per frames, for each step within +-`steps`, against `heard` (frame, v):
    (keys, step, _st, _stt, _tv, _tin), sums of the train, its squares, its products with v and its values where v has a frame.

    No impulse is drawn as rows: a share of one is linear in its place between two breaks, so sums of weights and of weight times place, by
    frame and bin of 1 / per, give each step's train, and a block of frames draws them all in one array.
    """
    keys = list(keys)
    frame = F.floor("at").cast("bigint")
    place = F.col("at") - F.floor("at")
    bins = impulses.groupBy(*keys, frame.alias("frame"), F.least(F.floor(place * per), F.lit(per - 1)).cast("bigint").alias("bin")).agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * place).alias("wp"))
    shifts = np.arange(-steps, steps + 1) / per
    reach = int(np.ceil(steps / per))
    sums = ("_st", "_stt", "_tv", "_tin", "_met", "_known")

    def drawn(batches):
        for batch in batches:
            found = []
            for blk, rows in zip(batch.column("_blk").to_pylist(), batch.column("_rows")):
                at, bin_, w, wp, v, audio = (rows.values.field(c).to_numpy(zero_copy_only=False) for c in ("frame", "bin", "w", "wp", "v", "audio"))
                at, audio = at - blk * size, audio.astype(bool)
                count = int(min(size, max(1, at.max() + reach + 3)))
                hit = ~audio
                train, touched = K.shifted_trains(at[hit], bin_[hit], w[hit], wp[hit], shifts, per, count)
                there = np.zeros(count, dtype=bool)
                there[at[audio & (at >= 0) & (at < count)]] = True
                level = K.dense(at[audio], v[audio], 0, count)
                known = ~np.isnan(level)
                # Plain sums: a matrix product would start threads in every task.
                found.append([train.sum(1), (train * train).sum(1), (train * np.where(known, level, 0.0)).sum(1), (train * there).sum(1),
                              (touched & there).sum(1, dtype=np.float64), (touched & known).sum(1, dtype=np.float64)])
            if found:
                columns = [pa.array([m[i] for m in found], pa.list_(pa.float64())) for i in range(len(sums))]
                yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *columns], names=[*keys, *sums])

    none = F.lit(None).cast("double")
    rows = bins.withColumn("v", none).withColumn("audio", F.lit(False)).unionByName(
        heard.select(*keys, "frame", F.lit(None).cast("bigint").alias("bin"), none.alias("w"), none.alias("wp"), F.col("v").cast("double"), F.lit(True).alias("audio")))
    blocks = halo(rows, "frame", size, reach + 2, reach + 1).groupBy(*keys, "_blk").agg(
        F.collect_list(F.struct("frame", F.coalesce("bin", F.lit(0).cast("bigint")).alias("bin"), "w", "wp", "v", "audio")).alias("_rows"))
    schema = T.StructType([*blocks.select(*keys).schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in sums]])
    each = blocks.mapInArrow(drawn, schema).select(*keys, F.posexplode(F.arrays_zip(*sums)).alias("_k", "_m"))
    total = each.groupBy(*keys, (F.col("_k") - steps).alias("step")).agg(*[F.sum(f"_m.{c}").alias(c) for c in sums])
    return total.where("_met > 0").select(*keys, "step", "_st", "_stt", F.when(F.col("_known") > 0, F.col("_tv")).alias("_tv"), "_tin")


def impulse_align(impulses: DataFrame, onsets: DataFrame, keys: Sequence[str], value: str, search_s: float = C.ALIGN_SEARCH_S,
                  fps: float = C.FPS, size: int = BLOCK) -> DataFrame:
    """Where weighted onsets best fit an onset series: offset_s, r, margin, runner_up_s, sure.

    Only onsets that can land in the series count. Both sides are normalised once by their whole
    energy; the best whole-frame lag is refined at 0.05-frame steps by drawing the train anew (shifted_moments).
    """
    keys = list(keys)
    reach = round(search_s * fps)
    audio = settle(onsets.groupBy(*keys).agg(F.avg(value).alias("_mu"), (F.var_pop(value) * F.count(value)).alias("_va"), F.count("*").alias("_n")))
    near = impulses.join(audio, keys).where((F.col("t") >= -search_s) & (F.col("t") <= F.col("_n") / fps + search_s))
    near = settle(near.select(*keys, "t", "weight"))

    def spanned(sums: DataFrame) -> DataFrame:
        spans = near.groupBy(*keys).agg(F.floor(F.max("t") * fps).alias("_p"), F.min("t").alias("_t0"))
        length = F.greatest(F.col("_p") + 4 - F.greatest(F.lit(0), F.floor(F.least(F.lit(0.0), F.col("_t0")))), F.lit(1))
        return sums.join(spans, keys).withColumn("_len", length)

    train = impulse_train(near, keys, fps)
    both = settle(train.select(*keys, "frame", "train", F.lit(None).cast("double").alias("audio")).unionByName(
        onsets.select(*keys, "frame", F.lit(None).cast("double").alias("train"), F.col(value).alias("audio"))).groupBy(*keys, "frame").agg(
        F.max("train").alias("train"), F.max("audio").alias("audio")))
    whole_train = train.groupBy(*keys).agg(F.sum("train").alias("_st"), F.sum(F.col("train") * F.col("train")).alias("_stt"))
    facts = settle(spanned(whole_train).join(audio, keys))
    sums = lag_sums(both, keys, -reach, reach, "train", "audio", size=size)
    # The audio's sum over the train's span shifts with the lag: read from a train of ones.
    ones = both.withColumn("train", F.when((F.col("frame") >= 0), F.lit(1.0)))
    spans = facts.select(*keys, "_p")
    inside = ones.join(spans, keys).withColumn("train", F.when((F.col("frame") >= 0) & (F.col("frame") < F.col("_p") + 4), 1.0)).drop("_p")
    span = settle(lag_sums(inside, keys, -reach, reach, "train", "audio", size=size).select(*keys, "lag", F.col("sab").alias("_sa"), F.col("n").alias("_na")))
    curve = sums.join(span, [*keys, "lag"], "right").join(facts, keys)
    mean = F.col("_st") / F.col("_len")
    top = (F.coalesce("sab", F.lit(0.0)) - F.col("_mu") * F.coalesce("sa", F.lit(0.0))) - mean * (F.col("_sa") - F.col("_mu") * F.col("_na"))
    norm = F.sqrt(F.greatest(F.col("_stt") - F.col("_st") * mean, F.lit(0.0)) * F.col("_va"))
    curve = settle(curve.select(*keys, "lag", F.when(norm > 1e-12, top / norm).otherwise(0.0).alias("r")))
    best = settle(best_and_runner_up(curve, keys, round(C.RUNNER_UP_S * fps)))
    whole = settle(curve.groupBy(*keys).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("_at")))
    moved = near.join(whole, keys).select(*keys, (F.col("t") * fps + F.col("_at")).alias("at"), "weight")
    with arrow_batches(near.sparkSession, 256):
        fine = settle(shifted_moments(moved, onsets.select(*keys, "frame", F.col(value).alias("v")), keys, 20, 20, size))
    energy = spanned(fine).join(audio, keys).join(whole, keys)
    span_at = span.withColumnRenamed("lag", "_at")
    energy = energy.join(span_at, [*keys, "_at"])
    m2 = F.col("_st") / F.col("_len")
    r = ((F.col("_tv") - F.col("_mu") * F.col("_tin")) - m2 * (F.col("_sa") - F.col("_mu") * F.col("_na"))) / F.nullif(
        F.sqrt(F.greatest(F.col("_stt") - F.col("_st") * m2, F.lit(0.0)) * F.col("_va")), F.lit(0.0))
    scored = energy.select(*keys, F.col("step").alias("lag"), F.coalesce(r, F.lit(0.0)).alias("r"))
    peak = best_and_runner_up(settle(scored), keys, 100).select(*keys, F.col("lag").alias("_step"), F.col("r").alias("_fine"))
    runner_r = F.col("r") - F.col("margin")
    out = best.select(*keys, "r", "margin", "runner_up").join(whole, keys).join(peak, keys)
    margin = F.col("_fine") - runner_r
    return out.select(*keys, ((F.col("_at") + F.col("_step") * 0.05) / fps).alias("offset_s"), F.col("_fine").alias("r"), margin.alias("margin"),
                      (F.col("runner_up") / fps).alias("runner_up_s"),
                      ((F.col("_fine") >= C.ALIGN_MIN_R) & (margin.isNull() | (margin >= C.ALIGN_MIN_MARGIN))).alias("sure"))
