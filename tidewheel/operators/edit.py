"""Edit planning: section proposals, cut boundaries, composition, highlights, output plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel import constants as C
from tidewheel.functions import scalar as S
from tidewheel.operators.blocks import number_rows
from tidewheel.operators.joins import clip_intervals, interval_join, round_robin
from tidewheel.session import settle

MIN_SECTIONS, MAX_SECTIONS = 3, 6
MOMENT_FROM_S, MOMENT_SONG_S = 15.0, 45.0


def propose_sections(songs: DataFrame, quiet: DataFrame, jumps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Section boundaries per song (keys, boundaries array): quiet edges and jumps at least
    max(4 s, 5 %) apart, or even slices when that leaves fewer than 3 or more than 6 sections.

    `songs` has duration, `quiet` start and end, `jumps` t. Only distinct hundredths of a second
    inside a song become candidates.
    """
    keys = list(keys)
    times = (quiet.select(*keys, F.explode(F.array("start", "end")).alias("_t"))
             .unionByName(jumps.select(*keys, F.col("t").alias("_t"))).select(*keys, F.round("_t", 2).alias("_t")).distinct())
    listed = times.groupBy(*keys).agg(F.collect_list("_t").alias("_times"))
    end = F.round("duration", 2)
    gap = F.greatest(F.lit(4.0), F.col("duration") * 0.05)
    base = songs.select(*keys, "duration").join(listed, keys, "left").withColumn("_gap", gap).withColumn("_end", end)
    ordered = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("_end")),
                                                     F.coalesce("_times", F.array().cast("array<double>")))))
    # Greedy: a candidate is kept when it is far enough from the last one kept.
    kept = F.aggregate(F.slice(ordered, 2, F.size(ordered)), F.slice(ordered, 1, 1), lambda acc, t: F.when(
        t - F.element_at(acc, -1) >= F.col("_gap"), F.concat(acc, F.array(t))).otherwise(acc))
    last = F.element_at(F.col("_sorted"), -1)
    closed = F.when(F.element_at("_kept", -1) == last, F.col("_kept")).otherwise(
        F.concat(F.slice("_kept", 1, F.size("_kept") - 1), F.array(last)))
    n = F.size("_closed") - 1
    even = F.when(n < MIN_SECTIONS, MIN_SECTIONS).otherwise(MAX_SECTIONS)
    sliced = F.transform(F.sequence(F.lit(0), even), lambda i: F.round(F.col("duration") * i / even, 2))
    return (base.withColumn("_sorted", ordered).withColumn("_kept", kept).withColumn("_closed", closed)
            .select(*keys, F.when((n < MIN_SECTIONS) | (n > MAX_SECTIONS), sliced).otherwise(F.col("_closed")).alias("boundaries")))


def sections_of(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boundaries as rows: (keys, section, start, end)."""
    b = F.col("boundaries")
    pairs = F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b)), lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return proposals.select(*keys, F.posexplode(pairs).alias("section", "_p")).select(*keys, "section", "_p.*")


def auto_style(sections: DataFrame, loudness: str) -> DataFrame:
    """Cut density and effects by loudness: quieter sections cut less."""
    quiet = F.col(loudness) < 0.6
    return sections.withColumn("cut_density", F.when(quiet, "every_2_beats").otherwise("every_beat")).withColumn(
        "effects", F.when(quiet, F.array(F.lit("grain"), F.lit("vignette"))).otherwise(
            F.array(F.lit("grain"), F.lit("strobe"), F.lit("vignette"))))


def cut_boundaries(sections: DataFrame, beats: DataFrame, keys: Sequence[str], fps: int, bucket: float = 16.0) -> DataFrame:
    """Cuts that tile each section: (keys, section, k, start, end), all on the frame grid.

    `sections` has start, end, cut_density and bpm (used where a section has no beats), `beats` has t.
    Beats count from the section's start inclusive to its end inclusive; every n-th is a boundary;
    boundaries closer than a frame merge, and the last is the section's true end.
    """
    keys = list(keys)
    sec = [*keys, "section"]
    divisor = F.create_map(*[F.lit(x) for k, v in C.BEATS_PER_CUT.items() if v for x in (k, v)])[F.col("cut_density")]
    base = settle(sections.select(*sec, "start", "end", "bpm", divisor.alias("_div")))
    rhythmic = base.where(F.col("_div").isNotNull())
    found = settle(interval_join(beats.select(*keys, "t"), rhythmic, keys, "t", "start", "end", bucket, closed_end=True))
    silent = rhythmic.join(found.select(*sec).distinct(), sec, "left_anti").where(F.col("bpm") > 0)
    step = 60.0 / F.col("bpm")
    count = F.ceil((F.col("end") - F.col("start")) / step - 1e-9)
    grid = silent.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1))).withColumn(
        "t", F.col("start") + F.col("_k") * step)
    inner = found.select(*sec, "t", "start", "end", "_div").unionByName(grid.select(*sec, "t", "start", "end", "_div"))
    edges = rhythmic.select(*sec, F.explode(F.array("start", "end")).alias("t"), "start", "end", "_div")
    points = settle(inner.unionByName(edges).distinct())
    placed = F.floor((F.col("t") - F.col("start")) / 64.0).cast("bigint")
    ranked = number_rows(points, sec, ["t"], placed, "_n")
    picked = ranked.where(((F.col("_n") - 1) % F.col("_div") == 0) | (F.col("t") == F.col("end")))
    static = base.where(F.col("_div").isNull()).select(*sec, F.explode(F.array("start", "end")).alias("t"), "start", "end")
    snapped = picked.select(*sec, "t", "start", "end").unionByName(static).select(
        *sec, S.snap_to_frame(F.col("t"), fps).alias("t"), S.snap_to_frame(F.col("end"), fps).alias("_end"),
        S.snap_to_frame(F.col("start"), fps).alias("_start")).distinct()
    from tidewheel.operators.series import previous_row

    framed = settle(snapped.withColumn("_f", F.rint(F.col("t") * fps).cast("bigint")))
    linked = previous_row(framed, sec, "_f", "t", "_before")
    cuts = linked.where(F.col("_before").isNotNull()).select(*sec, F.col("_before").alias("start"), F.col("t").alias("end"))
    return number_rows(cuts, sec, ["start"], F.floor(F.col("start") / 64.0).cast("bigint"), "_n").withColumn(
        "k", F.col("_n") - 1).drop("_n")


def cut_effects(cuts: DataFrame, sections: DataFrame, jumps: DataFrame, onsets: DataFrame, keys: Sequence[str],
                bucket: float = 4.0) -> DataFrame:
    """Each cut's effects: section-wide looks always, a kaleidoscope every 7th cut after the first,
    freeze and strobe only on cuts that hold a jump or an onset."""
    keys = list(keys)
    cut = [*keys, "section", "k"]

    def holding(points: DataFrame, name: str) -> DataFrame:
        inside = interval_join(points.select(*keys, "t"), cuts.select(*cut, "start", "end"), keys, "t", "start", "end", bucket)
        return inside.select(*cut).distinct().withColumn(name, F.lit(True))

    marked = (cuts.join(sections.select(*keys, "section", "effects"), [*keys, "section"])
              .join(holding(jumps, "_jump"), cut, "left").join(holding(onsets, "_onset"), cut, "left"))
    jump, onset, k = F.coalesce("_jump", F.lit(False)), F.coalesce("_onset", F.lit(False)), F.col("k")
    keep = lambda e: (F.when(e == "kaleidoscope", (k > 0) & (k % 7 == 0)).when(e == "freeze_on_peak", jump)
                      .when(e == "strobe", onset).otherwise(True))
    return marked.withColumn("effects", F.filter("effects", keep)).drop("_jump", "_onset")


def compose(sections: DataFrame, beats: DataFrame, assets: DataFrame, jumps: DataFrame, onsets: DataFrame,
            keys: Sequence[str], fps: int, shuffle: Column | None = None,
            window: tuple[Column, Column] | None = None) -> DataFrame:
    """The edit: contiguous cuts with their source, section, effects and a running index.

    `assets` has station and path; each section cycles through its station's assets.
    """
    keys = list(keys)
    cuts = settle(cut_effects(settle(cut_boundaries(sections, beats, keys, fps)), sections, jumps, onsets, keys))
    stationed = cuts.join(sections.select(*keys, "section", "station", "cut_density"), [*keys, "section"])
    sourced = round_robin(stationed, assets, ["station"], "k", "path", "source_path", shuffle=shuffle)
    indexed = number_rows(sourced, keys, ["start", "end"], F.floor(F.col("start") / 3600.0).cast("bigint"), "_n")
    edit = indexed.withColumn("idx", F.col("_n") - 1).withColumn(
        "is_beat_aligned", F.col("cut_density") != "static").drop("_n", "k", "cut_density")
    return edit if window is None else clip_intervals(settle(edit), keys, "start", "end", *window, fps)


def highlight(jumps: DataFrame, keys: Sequence[str], t: str, z: str, songs: DataFrame | None = None) -> DataFrame:
    """The highest jump per song (the earliest of equals). With `songs` (duration), one worth pointing
    at: not in the first 15 s, nor in a song under 45 s."""
    rows = jumps
    if songs is not None:
        rows = jumps.join(songs.select(*keys, "duration"), list(keys)).where(
            (F.col("duration") >= MOMENT_SONG_S) & (F.col(t) >= MOMENT_FROM_S))
    return rows.groupBy(*keys).agg(F.max_by(t, F.struct(F.round(z, 9), -F.col(t))).alias("highlight_t"))


def chapters(sections: DataFrame, keys: Sequence[str], start: str, name: str, skip_first: bool = False) -> DataFrame:
    """Section starts as timed rows: (keys, t, text). Timed comments skip the first section, and a
    song with one section has none."""
    out = sections
    if skip_first:
        first = sections.groupBy(*keys).agg(F.min(start).alias("_first"))
        out = sections.join(first, list(keys)).where(F.col(start) > F.col("_first"))
    return out.select(*keys, F.col(start).alias("t"), F.concat(S.time_text(F.col(start)), F.lit(" "), F.col(name)).alias("text"))


def teaser_start(duration: Column, length: Column, given: Column) -> Column:
    """Where a teaser starts: as given, else centred."""
    return F.coalesce(given, F.greatest(F.lit(0.0), duration / 2 - length / 2))


def thumbnail_times(songs: DataFrame, keys: Sequence[str], duration: str, count: int) -> DataFrame:
    rows = songs.select(*keys, duration, F.explode(F.sequence(F.lit(1), F.lit(count))).alias("n"))
    return rows.select(*keys, "n", (F.col(duration) * F.col("n") / (count + 1)).alias("t"))


def expand_outputs(cuts: DataFrame, keys: Sequence[str], name: str, platforms: str, endings: str, title: str) -> DataFrame:
    """One output per cut, platform and ending (either list may be empty), with its file name."""
    empty = lambda c: F.when(F.size(c) > 0, F.col(c))
    rows = cuts.withColumn("platform", F.explode_outer(empty(platforms))).withColumn("ending", F.explode_outer(empty(endings)))
    return rows.select(*keys, name, "platform", "ending", F.concat(
        F.concat_ws(".", title, name, "platform", "ending"), F.lit(".mp4")).alias("out"))


def sheet_picks(outputs: DataFrame, keys: Sequence[str], body: str, total: str, count: int) -> DataFrame:
    """Frames of a contact-sheet row: the last body frame, then `count` spread over the ending with
    both its ends, rounded half up in whole numbers."""
    span = F.col(total) - F.col(body)
    n = F.greatest(F.lit(1), F.least(F.lit(count), span)).cast("bigint")
    one = F.lit(1).cast("bigint")
    spread = F.when(n == 1, F.array(F.col(body).cast("bigint"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda k: F.col(body) + F.floor((2 * k * (span - 1) + n - 1) / F.greatest(2 * (n - 1), one)).cast("bigint")))
    picks = F.concat(F.array((F.col(body) - 1).cast("bigint")), spread)
    return outputs.select(*keys, F.posexplode(picks).alias("place", "frame"))


def plan_covers(wanted: DataFrame, keys: Sequence[str], platform: str, width: str, height: str, portrait: str,
                reel: str = "instagram-reel-cover", preview: str = "instagram-grid-thumbnail") -> DataFrame:
    """Each cover's source and method by its shape; a reel cover brings its grid preview along."""
    w, h = F.col(width), F.col(height)
    tall = F.col(portrait) & S.same_aspect(w, h, F.lit(9), F.lit(16))
    is_preview = F.col(platform) == preview
    method = (F.when(is_preview, "grid crop").when(w == h, "scale").when(tall, "scale")
              .when(w >= 3 * h, "centre band").otherwise("pad-blur"))
    source = F.when(is_preview, reel).when(tall & (w != h), "portrait").otherwise("master")
    has_preview = wanted.where(is_preview).select(*keys).distinct()
    derived = wanted.where(F.col(platform) == reel).join(has_preview, list(keys), "left_anti").withColumn(
        platform, F.lit(preview))
    return wanted.unionByName(derived).select(*keys, platform, source.alias("source"), method.alias("method"))
