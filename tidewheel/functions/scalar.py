"""Column expressions: levels, rounding, grid arithmetic, easing, sizes, colour, time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel import constants as C


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def round_places(x: Column, places: int) -> Column:
    """Rounded half away from zero as the scaled double stands, not as its shortest decimal does (0.285 is just under the half: 0.28).

    What is too large to be scaled has no such places and stays."""
    scale = F.lit(10.0 ** places)
    rounded = F.round(x * scale, 0) / scale
    return F.when(F.abs(rounded) < float("inf"), rounded).otherwise(x)


# ---- levels
def to_db(mean_square: Column) -> Column:
    return F.greatest(10.0 * F.log10(F.greatest(mean_square, F.lit(1e-30))), F.lit(C.FLOOR_DB))


def db_to_power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def db_below_peak(db: Column, peak: Column, top_db: float = 80.0) -> Column:
    """dB relative to the series' own peak, no lower than `top_db` under it."""
    return F.greatest(db - peak, F.lit(-top_db))


def centroid_level(hz: Column, rms_db: Column) -> Column:
    """Centroid on 0..1; silence has none."""
    return F.when(rms_db <= C.FLOOR_DB, 0.0).otherwise(clamp(hz / C.CENTROID_SCALE_HZ))


def side_contrast(mid_db: Column, side_db: Column, side_to_mid_db: Column) -> Column:
    """Centre over sides in dB, clipped; NULL where the two channels are one signal,
    the bottom of the range where the band is silent."""
    limit = C.VOCAL_CONTRAST_LIMIT_DB
    return (F.when(side_to_mid_db <= C.DUAL_MONO_DB, F.lit(None).cast("double"))
            .when(mid_db <= C.FLOOR_DB, F.lit(-limit))
            .otherwise(clamp(mid_db - side_db, -limit, limit)))


def mid(left: Column, right: Column) -> Column:
    """Sample blocks folded to the middle; a mono block (no right) is its own middle."""
    return F.when(right.isNull(), left).otherwise(F.zip_with(left, right, lambda a, b: (a + b) / F.lit(2.0)))


def side(left: Column, right: Column) -> Column:
    """Half the difference of the channels; NULL for mono."""
    return F.when(right.isNotNull(), F.zip_with(left, right, lambda a, b: (a - b) / F.lit(2.0)))


# ---- rounding and frames
def round_half_even(x: Column, decimals: int) -> Column:
    """Half-even at `decimals`, and never a negative zero."""
    scale = float(10 ** decimals)
    return F.rint(x * scale) / scale + 0.0


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def snap_to_frame(t: Column, fps: float) -> Column:
    return F.rint(t * fps) / fps


def cut_clock(t: Column, fps: float) -> Column:
    """A cut time on its frame, floored to the microsecond."""
    return F.floor(F.rint(t * fps) / fps * 1e6 + 1e-3) / 1e6


def frame_on_grid(t: Column, t0: float, fps: float, frames: int, tolerance: float = 0.01) -> Column:
    """The frame a time sits on; NULL when it is between frames or outside the range."""
    x = (t - t0) * fps
    k = F.floor(x + 0.5)
    return F.when((k >= 0) & (k < frames) & (F.abs(x - k) <= tolerance), k)


def first_frame(t: Column, fps: float, t0: float = 0.0) -> Column:
    """The first frame at or after a time."""
    return F.ceil((t - t0) * fps - 1e-6)


def held_time(t: Column, rate: float = 12.0) -> Column:
    """Time held at a slower rate: a drawing on twos at 12 a second."""
    return F.floor(t * rate + 1e-6) / rate


# ---- the grid
def bar_start(bar: Column, downbeat: Column, bar_seconds: Column) -> Column:
    return downbeat + (bar - 1) * bar_seconds


def bar_of(t: Column, downbeat: Column, bar_seconds: Column) -> Column:
    return (t - downbeat) / bar_seconds


def last_beat(t: Column, downbeat: Column, beat: Column) -> Column:
    return downbeat + F.floor((t - downbeat) / beat + 1e-6) * beat


def since_beat(t: Column, downbeat: Column, beat: Column) -> Column:
    return t - last_beat(t, downbeat, beat)


def beat_in_bar(t: Column, downbeat: Column, beat: Column, per_bar: int = 4) -> Column:
    return F.pmod(F.floor((t - downbeat) / beat + 1e-6), F.lit(per_bar).cast("bigint"))


def is_backbeat(t: Column, downbeat: Column, beat: Column, per_bar: int = 4) -> Column:
    return beat_in_bar(t, downbeat, beat, per_bar).isin(1, 3)


def tempo_prior(bpm: Column) -> Column:
    octaves = F.log2(bpm / C.PRIOR_BPM) / C.PRIOR_OCTAVES
    return F.exp(-0.5 * octaves * octaves)


def octave_range(alt_bpm: Column, lo: float = C.BPM_RANGE[0], hi: float = C.BPM_RANGE[1]) -> tuple[Column, Column]:
    """A search range that keeps `alt_bpm` and shuts out its octaves: 25 % around, outward to 5."""
    return (F.greatest(F.lit(lo), F.floor(alt_bpm * 0.8 / 5.0) * 5.0),
            F.least(F.lit(hi), F.ceil(alt_bpm * 1.25 / 5.0) * 5.0))


def pulse_length(num: Column, den: Column, clocks: Column) -> Column:
    """The felt beat of a meter in quarter notes; `clocks` is its metronome click (NULL: none)."""
    clicks = num * 96.0 / den / clocks
    whole = (clicks >= 1.0) & (F.abs(clicks - F.rint(clicks)) < 1e-9)
    return (F.when(clocks.isNotNull() & (clocks != 24) & (clocks >= 6) & whole, clocks / 24.0)
            .when((den >= 8) & (num > 3) & (num % 3 == 0), F.lit(12.0) / den)
            .otherwise(F.lit(4.0) / den))


def quarters_per_bar(num: Column, den: Column) -> Column:
    return num * 4.0 / den


# ---- easing and remapping
def lerp(a: Column, b: Column, u: Column) -> Column:
    return a + (b - a) * u


def inv_lerp(a: Column, b: Column, v: Column) -> Column:
    return (v - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a)


def remap(v: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return lerp(b0, b1, clamp(inv_lerp(a0, a1, v)))


def fract(x: Column) -> Column:
    return x - F.floor(x)


def ease(u: Column) -> Column:
    u = clamp(u)
    return u * u * (3.0 - 2.0 * u)


def ease_in(u: Column) -> Column:
    u = clamp(u)
    return u * u * u


def ease_out(u: Column) -> Column:
    left = 1.0 - clamp(u)
    return 1.0 - left * left * left


def ease_in_out(u: Column) -> Column:
    u = clamp(u)
    left = 2.0 - 2.0 * u
    return F.when(u < 0.5, 4.0 * u * u * u).otherwise(1.0 - left * left * left / 2.0)


def ramp(t: Column, a: Column, b: Column) -> Column:
    """0 before a, 1 after b, eased between."""
    return ease((t - a) / (b - a))


def smoothstep(edge0: float, edge1: float, x: Column) -> Column:
    """Eased ramp from edge0 to edge1; equal edges make a step, reversed ones a falling ramp."""
    if edge0 == edge1:
        return F.when(x >= edge1, 1.0).otherwise(0.0)
    return ease((x - edge0) / (edge1 - edge0))


def hit(t: Column, t0: Column, attack: float, decay: float) -> Column:
    """0 before t0, a linear attack, then exponential decay."""
    since = t - t0
    return (F.when(since < 0, 0.0).when(since < attack, since / attack if attack > 0 else F.lit(1.0))
            .otherwise(F.exp(-(since - attack) / decay)))


# ---- hash noise
def hash_noise(seed: int, name: Column, *key: Column) -> Column:
    """Repeatable noise in [0, 1): a named stream read at any key, in any partition and by any engine that has MD5.

    The first 52 bits of the MD5 of seed, name and key, joined by bars; NULL reads as "null".
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in (name, *key)])
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(13)), 16, 10).cast("bigint") / float(1 << 52)



# ---- sizes
def _even(x: Column) -> Column:
    return F.greatest(F.lit(2), 2 * F.rint(x / 2).cast("bigint"))


def _even_up(x: Column) -> Column:
    return F.greatest(F.lit(2), 2 * F.ceil(x / 2 - 1e-9).cast("bigint"))


def same_aspect(aw: Column, ah: Column, bw: Column, bh: Column, tolerance: float = C.ASPECT_TOLERANCE) -> Column:
    return F.abs(aw * bh - ah * bw) <= tolerance * ah * bw


def fit_size(sw: Column, sh: Column, fw: Column, fh: Column) -> tuple[Column, Column]:
    """The largest even size of the source's shape inside the frame."""
    wide = sw * fh >= sh * fw
    return (F.when(wide, fw).otherwise(F.least(fw, _even(fh * sw / sh))),
            F.when(wide, F.least(fh, _even(fw * sh / sw))).otherwise(fh))


def cover_size(sw: Column, sh: Column, fw: Column, fh: Column) -> tuple[Column, Column]:
    """The smallest even size of the source's shape that covers the frame."""
    wide = sw * fh >= sh * fw
    return (F.when(wide, F.greatest(fw, _even_up(fh * sw / sh))).otherwise(fw),
            F.when(wide, fh).otherwise(F.greatest(fh, _even_up(fw * sh / sw))))


# ---- colour
def hue_distance(a: Column, b: Column) -> Column:
    """Distance on a hue circle of 180 degrees."""
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def hex_hue(colour: Column) -> Column:
    """Hue (0..180) of a #rrggbb colour; grey is 0."""
    text = F.regexp_replace(colour, "^#", "")
    r, g, b = [F.conv(F.substring(text, k, 2), 16, 10).cast("double") / 255.0 for k in (1, 3, 5)]
    top, bottom = F.greatest(r, g, b), F.least(r, g, b)
    span = F.when(top == bottom, F.lit(None).cast("double")).otherwise(top - bottom)
    sixth = (F.when(top == r, (g - b) / span).when(top == g, 2.0 + (b - r) / span)
             .otherwise(4.0 + (r - g) / span)) / 6.0
    return F.coalesce(F.pmod(sixth, F.lit(1.0)), F.lit(0.0)) * 180.0


def target_hue(highlight: Column, temperature: Column) -> Column:
    """A look's own highlight colour, else a warm or cool guess."""
    return F.when(highlight.isNotNull(), hex_hue(highlight)).when(temperature >= 0, 15.0).otherwise(100.0)


def look_score(hue: Column, saturation: Column, brightness: Column, want_hue: Column, look_saturation: Column,
               temperature: Column) -> Column:
    """How well an asset fits a look; higher is better."""
    by_hue = 1.0 - hue_distance(hue, want_hue) / 90.0
    by_saturation = 1.0 - F.abs(saturation - clamp(0.5 + look_saturation / 4.0))
    by_brightness = 1.0 - F.abs(brightness - F.when(temperature < 0, 0.35).otherwise(0.55))
    return 0.5 * by_hue + 0.3 * by_saturation + 0.2 * by_brightness


# ---- time text
def time_text(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    whole = F.floor(seconds).cast("bigint")
    h, m, s = F.floor(whole / 3600).cast("bigint"), F.floor(whole / 60).cast("bigint") % 60, whole % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
