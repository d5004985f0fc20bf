"""Rule evaluation over tables: validation, specifications, planning. Findings are rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel import constants as C
from tidewheel.functions import scalar as S
from tidewheel.functions.platform_specs import platforms
from tidewheel.operators.blocks import neighbour, number_rows

MAX_STEP_PER_ROUND_DB = 3.0


def findings(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One row per broken rule: `rules` are (rule, level or NULL, message). A NULL level is no finding."""
    graded = df.select("*", *[level.alias(f"_level{i}") for i, (_, level, _) in enumerate(rules)])
    cells = [F.when(F.col(f"_level{i}").isNotNull(), F.struct(
        F.lit(rule).alias("rule"), F.col(f"_level{i}").alias("level"), message.alias("message")))
        for i, (rule, _, message) in enumerate(rules)]
    return graded.select(*keys, F.explode(F.array(*cells)).alias("_f")).where(F.col("_f").isNotNull()).select(*keys, "_f.*")


def validate(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, as `refuse` findings; `rules` maps a rule's name to its broken condition."""
    return findings(df, keys, [(rule, F.when(broken, F.lit("refuse")), F.lit(rule)) for rule, broken in rules.items()])


def section_rules() -> dict[str, Column]:
    """What a section row must satisfy."""
    unknown = F.size(F.array_except("effects", F.array(*[F.lit(e) for e in C.EFFECTS]))) > 0
    return {
        "end after start": F.col("end") <= F.col("start"),
        "known density": ~F.col("cut_density").isin(list(C.BEATS_PER_CUT)),
        "known effects": unknown,
    }


def look_rules() -> dict[str, Column]:
    """What a look (station) row must satisfy."""
    between = lambda c, lo, hi: (F.col(c) < lo) | (F.col(c) > hi)
    hexed = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike("^#[0-9a-fA-F]{6}$")
    return {
        "temperature -1..1": between("temperature", -1, 1),
        "saturation 0..2": between("saturation", 0, 2),
        "duotone pair": F.col("shadow").isNull() != F.col("highlight").isNull(),
        "duotone colours": hexed("shadow") | hexed("highlight"),
    }


def contiguity(cuts: DataFrame, keys: Sequence[str], index: str, start: str, end: str, slack: float = 1e-6) -> DataFrame:
    """Where a timeline does not start at 0, overlaps or leaves a gap: (keys, idx, rule)."""
    linked = neighbour(cuts, keys, index, {"_end": (end, -1)})
    rule = (F.when(F.col("_end").isNull() & (F.col(start) > slack), "late start")
            .when(F.col(start) < F.col("_end") - slack, "overlap").when(F.col(start) > F.col("_end") + slack, "gap"))
    return linked.select(*keys, F.col(index).alias("idx"), rule.alias("rule")).where(F.col("rule").isNotNull())


def timeline_problems(points: DataFrame, expected: DataFrame, keys: Sequence[str], pts: str, frames: str,
                      step: float) -> DataFrame:
    """A fixed-step time index checked: its count, its first at 0, and the first gap, repeat or crowding."""
    keys = list(keys)
    exact = abs(step - round(step)) < 1e-9
    numbered = number_rows(points.select(*keys, F.col(pts).alias("_p")), keys, ["_p"],
                           F.floor(F.col("_p") / (step * 4096)).cast("bigint"), "_n")
    linked = neighbour(numbered, keys, "_n", {"_q": ("_p", -1)})
    d = F.col("_p") - F.col("_q")
    off = (d != round(step)) if exact else (F.abs(d - step) > 1)
    kind = F.when(d > step, "gap").when(d == 0, "repeat").otherwise("too close")
    worst = linked.groupBy(*keys).agg(
        F.count("*").alias("_count"), F.min("_p").alias("_first"),
        F.min(F.when(F.col("_q").isNotNull() & off, F.struct((F.col("_n") - 2).alias("i"), kind.alias("k")))).alias("_bad"))
    all_ = expected.join(worst, keys, "left").withColumn("_count", F.coalesce("_count", F.lit(0)))
    none = F.lit(None).cast("bigint")
    cells = F.array(
        F.struct(F.when(F.col("_count") != F.col(frames), "count").alias("rule"), none.alias("at")),
        F.struct(F.when(F.col("_first") != 0, "first").alias("rule"), none.alias("at")),
        F.struct(F.col("_bad.k").alias("rule"), F.col("_bad.i").alias("at")))
    return all_.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.rule", "_c.at").where(F.col("rule").isNotNull())


def platform_findings(artifacts: DataFrame, keys: Sequence[str], specs: DataFrame | None = None) -> DataFrame:
    """Artifacts held to their platform's specification: (keys, platform, rule, level, message).

    `artifacts` has platform, width, height, fps, seconds, has_audio, file_mb, lufs; a NULL is not
    known and not checked. `specs` is any table of the same columns; the built-in one has a fixed
    number of rows, so it is broadcast.
    """
    keys = list(keys)
    specs = F.broadcast(platforms(artifacts.sparkSession)) if specs is None else specs
    joined = artifacts.join(specs.select("platform", "kind", "aspect_fixed", "sizes", *[
        F.col(c).alias(f"s_{c}") for c in ("width", "height", "audio", "lufs")], *[
        c for c in specs.columns if c.startswith(("min_", "max_", "soft_", "fps_"))]), "platform")
    a = F.col
    video = a("kind") == "video"
    own = F.struct(a("s_width").alias("w"), a("s_height").alias("h"))
    sizes = F.concat(F.array(own), a("sizes"))
    known = a("width").isNotNull() & a("height").isNotNull() & ~F.array_contains(
        sizes, F.struct(a("width").cast("int").alias("w"), a("height").cast("int").alias("h")))
    broken = F.lit(False)
    for outside in (a("width") < a("min_width"), a("height") < a("min_height"),
                    a("width") > a("max_width"), a("height") > a("max_height")):
        broken = broken | F.coalesce(outside, F.lit(False))
    alike = F.filter(sizes, lambda s: S.same_aspect(a("width").cast("double"), a("height").cast("double"), s["w"], s["h"]))
    # Computed once: the lists are short, but walking them is the costly part of a row.
    joined = joined.withColumn("_known", known).withColumn("_shape", F.get(alike, F.lit(0)))
    known, first = a("_known"), a("_shape")
    shaped = first.isNotNull()
    area, want = a("width").cast("bigint") * a("height"), first["w"].cast("bigint") * first["h"]
    size_level = (F.when(known & broken, "refuse")
                  .when(known & shaped & (area < want) & a("min_width").isNull() & a("min_height").isNull(), "warn")
                  .when(known & shaped & (area > want) & a("max_width").isNull() & a("max_height").isNull(), "info"))
    aspect_level = F.when(known & ~shaped, F.when(a("aspect_fixed"), "refuse").otherwise("warn"))
    t, slack = a("seconds"), C.TIME_SLACK_S
    length_level = F.when(video, F.when(t < a("min_seconds") - slack, "refuse").when(t > a("max_seconds") + slack, "refuse")
                          .when(t > a("soft_seconds") + slack, "warn"))
    listed = lambda c: F.exists(c, lambda r: F.abs(a("fps") - r) < C.FPS_SLACK)
    fps_level = F.when(video & a("fps").isNotNull(), F.when(a("fps") < a("fps_low") - C.FPS_SLACK, "refuse")
        .when(a("fps") > a("fps_high") + C.FPS_SLACK, "refuse")
        .when((F.size("fps_allowed") > 0) & ~listed("fps_allowed"), "refuse")
        .when((F.size("fps_common") > 0) & ~listed("fps_common"), "info"))
    audio_level = F.when(video & a("has_audio") & (a("s_audio") == "none"), "refuse")
    file_level = F.when(a("file_mb") > a("max_mb"), "refuse").when(a("file_mb") > a("soft_mb"), "warn")
    mbps = a("file_mb") * 8 / F.nullif(t, F.lit(0.0))
    rate_level = F.when(video, F.when(mbps > a("max_mbps"), "warn").when(mbps < a("min_mbps"), "warn"))
    loud_level = F.when(video & a("has_audio") & a("lufs").isNotNull() & a("s_lufs").isNotNull(), "info")
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    return findings(joined, [*keys, "platform"], [
        ("size", size_level, text("%dx%d is outside the published sizes", "width", "height")),
        ("aspect", aspect_level, text("%dx%d is another shape", "width", "height")),
        ("length", length_level, text("%.3f s", "seconds")),
        ("frame rate", fps_level, text("%.3f fps", "fps")),
        ("audio", audio_level, F.lit("an audio stream where the picture goes alone")),
        ("file size", file_level, text("%.2f MB", "file_mb")),
        ("bitrate", rate_level, text("%.1f Mbps on average", mbps)),
        ("loudness", loud_level, text("%.1f LUFS against %.0f", "lufs", "s_lufs")),
    ])


def merge_measured(planned: DataFrame, measured: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned findings whose rule was not measured, plus the measured ones. `known` lists (keys, rule)."""
    on = [*keys, "rule"]
    return planned.join(known.select(*on).distinct(), on, "left_anti").unionByName(measured)


def known_rules(measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rules a measurement settles, from which of its values are present."""
    have = {
        "size": F.col("width").isNotNull() & F.col("height").isNotNull(),
        "aspect": F.col("width").isNotNull() & F.col("height").isNotNull(),
        "length": F.col("seconds").isNotNull(),
        "bitrate": F.col("file_mb").isNotNull() & F.col("seconds").isNotNull(),
        "frame rate": F.col("fps").isNotNull(),
        "audio": F.col("has_audio").isNotNull(),
        "file size": F.col("file_mb").isNotNull(),
        "loudness": F.col("lufs").isNotNull(),
    }
    return measured.select(*keys, F.explode(F.array(*[F.when(ok, F.lit(rule)) for rule, ok in have.items()])).alias("rule")).where(
        F.col("rule").isNotNull())


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("times")).where(F.col("times") > 1)


def printf2(x: Column) -> Column:
    """Two decimals, halves away from zero on the exact binary value."""
    return F.format_string("%.2f", x).cast("double")


def gain_plan(masters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start gain, planned loudness and ceiling per master.

    Columns in: lufs, true_peak, mode (loudness, fixed or auto), target_lufs, gain_db, ceiling (NULL: auto).
    """
    loud_mode = F.col("mode") == "loudness"
    start = F.when(loud_mode, F.round(F.col("target_lufs") - F.col("lufs"), 2)).otherwise(F.col("gain_db"))
    planned = F.when(loud_mode, F.col("target_lufs")).otherwise(F.col("lufs") + F.col("gain_db"))
    loud = planned > C.NORMALISED_LUFS
    ceiling = F.coalesce("ceiling", F.when(loud, C.LOUD_CEILING_DBTP).otherwise(C.CEILING_DBTP))
    hot = F.when(~loud_mode & (F.col("true_peak") > 0), "pre-master peak over 0")
    close = F.when(F.col("ceiling").isNotNull() & loud & (F.col("ceiling") > C.LOUD_CEILING_DBTP), "ceiling over -2 for a loud delivery")
    return masters.select(*keys, start.alias("start_gain"), planned.alias("planned_lufs"), ceiling.alias("ceiling_dbtp"),
                          F.array_join(F.array_compact(F.array(hot, close)), "; ").alias("warnings"))


def next_setting(rounds: DataFrame, settings: DataFrame, keys: Sequence[str], peak: str = "true_peak") -> DataFrame:
    """The setting to try after a round: lower by its worst overshoot in whole steps, within what is left.

    `settings` has mode, gain_db, limiter_dbfs, ceiling, step_db, max_steps, used. NULL settings mean
    nothing is left to step.
    """
    worst = rounds.groupBy(*keys).agg(F.max(peak).alias("_worst"))
    all_ = settings.join(worst, list(keys))
    left = F.col("max_steps") - F.col("used")
    jump = F.greatest(F.lit(1), F.floor(MAX_STEP_PER_ROUND_DB / F.col("step_db") + 1e-9))
    over = F.col("_worst") - F.col("ceiling")
    n = F.least(left, jump, F.greatest(F.lit(1), F.ceil(over / F.col("step_db") - 1e-9)))
    limited = F.col("mode") == "loudness"
    stuck = ((F.col("mode") == "fixed") | (left <= 0)
             | (limited & (F.col("limiter_dbfs").isNull() | (F.col("limiter_dbfs") <= C.LIMITER_FLOOR_DBFS))))
    gain = F.when(limited, F.col("gain_db")).otherwise(F.round(F.col("gain_db") - n * F.col("step_db"), 2))
    limiter = F.when(limited, F.greatest(F.round(F.col("limiter_dbfs") - n * F.col("step_db"), 2), F.lit(C.LIMITER_FLOOR_DBFS)))
    return all_.select(*keys, F.col("_worst").alias("worst_peak"), F.when(~stuck, gain).alias("gain_db"),
                       F.when(~stuck, limiter).alias("limiter_dbfs"),
                       F.when(stuck, F.col("used")).otherwise(F.col("used") + n).cast("int").alias("used"))


def edge_levels(samples: DataFrame, cuts: DataFrame, keys: Sequence[str], t: str, level_db: str, width: float = 0.010,
                near_silent: float = C.NEAR_SILENT_DBFS) -> DataFrame:
    """Cuts without a fade whose edge is not silent: (keys, cut, edge, level).

    `cuts` has cut, start, end, fade_in, fade_out and gain_db; `samples` a level per time.
    """
    from tidewheel.operators.joins import interval_join

    edges = cuts.select(*keys, "cut", "gain_db", F.explode(F.array(
        F.when((F.col("fade_in") == 0) & (F.col("start") >= 0), F.struct(F.lit("start").alias("edge"), F.col("start").alias("_a"))),
        F.when((F.col("fade_out") == 0) & (F.col("end") > 0), F.struct(
            F.lit("end").alias("edge"), F.greatest(F.col("end") - width, F.lit(0.0)).alias("_a"))))).alias("_e")).where(
        F.col("_e").isNotNull()).select(*keys, "cut", "gain_db", "_e.edge", "_e._a", (F.col("_e._a") + width).alias("_b"))
    near = interval_join(samples.select(*keys, t, level_db), edges, keys, t, "_a", "_b", max(width, 1e-6))
    level = F.max(F.col(level_db) + F.col("gain_db"))
    return near.groupBy(*keys, "cut", "edge").agg(level.alias("level")).where(F.col("level") > near_silent)


def reframe_plan(pictures: DataFrame, keys: Sequence[str], sizes: str, how: str) -> DataFrame:
    """How a picture becomes a platform's: copy, scale, or the named reframe, and how far it is enlarged.

    `sizes` is the platform's sizes, its own first; `how` is crop, pad-blur or pad-color (NULL: crop).
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    exact = F.exists(sizes, lambda s: (s["w"] == F.col("width")) & (s["h"] == F.col("height")))
    alike = F.get(F.filter(sizes, lambda s: S.same_aspect(w, h, s["w"], s["h"])), F.lit(0))
    own = F.get(F.col(sizes), F.lit(0))
    named = F.coalesce(F.col(how), F.lit("crop"))
    method = F.when(exact, "copy").when(alike.isNotNull(), "scale").otherwise(named)
    target = F.when(exact, F.struct(F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"))).otherwise(F.coalesce(alike, own))
    fit = S.fit_size(w, h, own["w"].cast("double"), own["h"].cast("double"))
    cover = S.cover_size(w, h, own["w"].cast("double"), own["h"].cast("double"))
    drawn = (F.when(method.isin("copy", "scale"), target["w"].cast("double"))
             .when(method == "crop", cover[0].cast("double")).otherwise(fit[0].cast("double")))
    return pictures.select(*keys, method.alias("method"), target["w"].alias("target_w"), target["h"].alias("target_h"),
                           (drawn / w).alias("enlarged"))


def manifest_problems(cuts: DataFrame, manifests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where a manifest and its cut disagree: rate, start, length, join, body frames, ending frames.

    `cuts` has fps, t0, dur; `manifests` m_fps, m_t0, m_dur, at, body and endings (array of frames).
    """
    j = cuts.join(manifests, list(keys))
    half = 0.5 / F.col("fps")
    same_rate = F.abs(F.col("m_fps") - F.col("fps")) <= 1e-6
    inside = (F.col("m_t0") < F.col("at")) & (F.col("at") < F.col("m_t0") + F.col("m_dur"))
    total = F.rint((F.col("t0") + F.col("dur")) * F.col("fps")) - F.rint(F.col("t0") * F.col("fps"))
    refuse = lambda c: F.when(same_rate & c, F.lit("refuse"))
    return findings(j, keys, [
        ("rate", F.when(~same_rate, F.lit("refuse")), F.lit("frame rates differ")),
        ("start", refuse(F.abs(F.col("m_t0") - F.col("t0")) > half), F.lit("starts differ")),
        ("length", refuse(F.abs(F.col("m_dur") - F.col("dur")) > half), F.lit("lengths differ")),
        ("join", refuse(~inside), F.lit("the join is outside the window")),
        ("body", refuse(inside & (F.col("body") != F.rint((F.col("at") - F.col("m_t0")) * F.col("fps")))), F.lit("the body has another length")),
        ("ending", refuse(F.exists("endings", lambda e: F.col("body") + e != total)), F.lit("an ending has another length")),
    ])


def first_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str, value: str, order: str) -> DataFrame:
    """The first parameter, in `order`, two key-value sets disagree on: (keys, name, a, b)."""
    on = [*keys, name]
    both = (a.select(*on, F.col(order).alias("_oa"), F.col(value).alias("_a"))
            .join(b.select(*on, F.col(order).alias("_ob"), F.col(value).alias("_b")), on, "full"))
    differ = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).withColumn("_o", F.coalesce("_oa", "_ob"))
    first = differ.groupBy(*keys).agg(F.min(F.struct("_o", F.col(name).alias("n"), F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_d"))
    return first.select(*keys, F.col("_d.n").alias(name), F.col("_d.a").alias("a"), F.col("_d.b").alias("b"))
