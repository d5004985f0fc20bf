"""Comparison and tempo operators on signals with known answers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import kernels as K
from tidewheel.operators import align as L
from tidewheel.operators import grid as G
from tidewheel.operators import notes as N
from tidewheel.operators import samples as A
from tidewheel.session import settle

KEYS = ["series_id"]


def rows(spark, **series):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "series_id string, frame long, value double")


def song(n=1200, seed=1):
    rng = np.random.default_rng(seed)
    return np.convolve(rng.normal(size=n + 20), np.ones(20) / 20, "same")[:n] * 40 - 30


@pytest.fixture(scope="module")
def pairs(spark):
    a = song()
    late = np.concatenate([np.full(37, -100.0), a])
    return settle(L.pair_up(rows(spark, same=a, late=a), rows(spark, same=a, late=late), KEYS))


def test_offset_curve_matches_numpy_across_blocks(spark, pairs):
    got = {(r["series_id"], r["lag"]): r["r"] for r in L.offset_curve(pairs, KEYS, 50, size=128).collect()}
    a = song()
    for lag in (-50, -7, 0, 37, 50):
        lo, hi = max(0, -lag), min(len(a), len(a) - lag)
        assert got["same", lag] == pytest.approx(np.corrcoef(a[lo:hi], a[lo + lag: hi + lag])[0, 1], abs=1e-9)


def test_a_wide_lag_search_over_gaps_matches_direct_sums(spark):
    rng = np.random.default_rng(6)
    a = song(9000, 6)
    b = np.concatenate([np.full(1700, -100.0), a])[:9500]
    holes = rng.random(len(a)) < 0.05
    old = spark.createDataFrame([(None, i, float(v)) for i, v in enumerate(a) if not holes[i]] + [("flat", i, 7.0) for i in range(500)], "series_id string, frame long, value double")
    new = spark.createDataFrame([(None, i, float(v)) for i, v in enumerate(b)] + [("flat", i, float(v)) for i, v in enumerate(a[:500])], "series_id string, frame long, value double")
    pair = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), [old.series_id.eqNullSafe(new.series_id), old.frame == new.frame], "full").select(
        F.coalesce(old.series_id, new.series_id).alias("series_id"), F.coalesce(old.frame, new.frame).alias("frame"), "old", "new")
    sums = {r.lag: r for r in L.lag_sums(pair.where("series_id IS NULL"), KEYS, -2000, 2000, size=4096).collect()}
    assert sorted(sums) == list(range(-2000, 2001))
    for lag in (-2000, -333, 0, 1700, 2000):
        at = np.array([i for i in range(len(a)) if not holes[i] and 0 <= i + lag < len(b)])
        x, y = a[at], b[at + lag]
        r = sums[lag]
        assert r.n == len(at)
        assert [r.sa, r.sb, r.saa, r.sbb, r.sab] == pytest.approx([x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()], rel=1e-10)
    flat = L.offset_curve(pair.where("series_id = 'flat'"), KEYS, 2000)
    assert {r.r for r in flat.collect()} == {-1.0}
    curve = {r.lag: r.r for r in L.offset_curve(pair.where("series_id IS NULL").withColumn("series_id", F.lit("x")), KEYS, 2000).collect()}
    assert max(curve, key=curve.get) == 1700 and curve[1700] == pytest.approx(1.0, abs=1e-9)


def test_windows_find_their_peaks_as_one_by_one():
    rng = np.random.default_rng(2)
    old, span, reach = np.repeat(rng.normal(size=80), 5) * 9, 60, 25
    new = np.concatenate([np.full(reach + 7, -100.0), old, np.full(reach, -100.0)])[:len(old) + 2 * reach]
    old[100:170] = 3.0
    starts = np.arange(0, len(old) - span + 1, 10)
    still, lag, r = K.window_peaks(old, new, starts, span, reach, 1.0, 0.002)
    for k, s in enumerate(starts):
        a = old[s:s + span]
        assert still[k] == (a.std() < 1.0)
        curve = []
        for g in range(2 * reach + 1):
            b = new[s + g:s + g + span]
            curve.append(np.corrcoef(a, b)[0, 1] if a.std() > 1e-9 and b.std() > 1e-6 else 0.0)
        peaks = [g - reach for g, v in enumerate(curve) if v >= max(curve) - 0.002 and v >= max([*curve[max(0, g - 1):g], *curve[g + 1:g + 2]]) - 1e-12]
        if not still[k]:
            assert lag[k] == min(peaks, key=lambda g: (abs(g), g)) and r[k] == pytest.approx(curve[lag[k] + reach], abs=1e-9)


def test_global_and_local_lags_find_the_delay(pairs):
    found = {r["series_id"]: r for r in L.global_offset(pairs, KEYS, 60, size=256).collect()}
    assert found["same"]["lag"] == 0 and found["same"]["r"] == 1.0
    assert found["late"]["lag"] == 37
    windows = settle(L.local_lags(pairs, KEYS, 200, 100, 50, size=300))
    lags = [r["lag"] for r in windows.where("series_id = 'late'").collect()]
    assert len(lags) == 11 and set(lags) == {37}
    kinds = {r["series_id"]: r for r in L.classify_lags(windows, L.global_offset(pairs, KEYS, 60), KEYS).collect()}
    assert kinds["same"]["kind"] == kinds["late"]["kind"] == "shift"


def test_tempo_change_is_found(spark):
    a = song(3000, 4)
    fast = np.interp(np.arange(round(len(a) / 1.02)) * 1.02, np.arange(len(a)), a)
    pair = settle(L.pair_up(rows(spark, fast=a), rows(spark, fast=fast), KEYS))
    windows = settle(L.local_lags(pair, KEYS, 400, 200, 100))
    found = L.tempo_change(pair, windows, KEYS, reach_s=1.0).collect()
    assert len(found) == 1 and found[0]["ratio"] == pytest.approx(1.02, abs=5e-4)


def test_trials_against_one_piece_equal_single_ones():
    rng = np.random.default_rng(3)
    a, others = rng.normal(size=2500) + 40, rng.normal(size=(5, 2512)) - 7
    a[::17], others[1, 40:300], others[2], others[3, 2000:] = np.nan, np.nan, np.nan, np.nan
    got = K.lag_moments_each(a, others, 13)
    for row, b in zip(got, others):
        assert np.allclose(row, K.lag_moments([(a, b)], 13), rtol=1e-9, atol=1e-7)


def test_median_slope_of_few_points_takes_no_rounds(monkeypatch):
    from tidewheel.operators import slopes

    def counted(*_):
        raise AssertionError("a round of counting pairs")

    x, y = np.array([0.0, 24, 24, 48, 72, 96]), np.array([1.0, 2, 3, 3, 4, 9])
    want = float(np.median([(y[j] - y[i]) / (x[j] - x[i]) for i in range(6) for j in range(i + 1, 6) if x[i] != x[j]]))
    monkeypatch.setattr(slopes, "falling_pairs", counted)
    assert slopes.median_slope(x, y) == pytest.approx(want, abs=1e-12)
    assert slopes.median_slope(np.ones(3), y[:3]) == 0.0


def clicks(bpm, seconds=40.0, fps=100):
    out = np.zeros(int(seconds * fps))
    at = np.arange(0.3, seconds - 0.1, 60.0 / bpm) * fps
    for p in at:
        out[int(p)] += 1 - (p - int(p))
        out[int(p) + 1] += p - int(p)
    return np.convolve(out, [0.25, 0.5, 0.25], "same")


def test_tempo_of_click_tracks(spark):
    onsets = settle(rows(spark, slow=clicks(93.5), mid=clicks(120.0), quick=clicks(174.0)))
    got = {r["series_id"]: r for r in G.estimate_tempo(onsets, KEYS, "value", size=1500).collect()}
    for name, bpm in (("slow", 93.5), ("mid", 120.0), ("quick", 174.0)):
        assert got[name]["bpm"] == pytest.approx(bpm, abs=0.05), name
        period = 60.0 / got[name]["bpm"]
        off = (got[name]["beat0"] - 0.3) % period
        assert min(off, period - off) < 0.015


def test_tempo_search_keeps_its_trials_out_of_rows(spark, monkeypatch):
    onsets = settle(rows(spark, slow=clicks(93.5), mid=clicks(120.0)))
    sizes = []

    def counted(df):
        out = settle(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "settle", counted)
    whole, cut = ({r["series_id"]: r for r in G.estimate_tempo(onsets, KEYS, "value", size=n).collect()} for n in (16384, 1500))
    # Two series of at most 12 starts and three blocks; a start has 651 trials.
    assert max(sizes) <= 2 * 12 * 3
    for name in whole:
        assert [whole[name][c] for c in ("bpm", "beat0", "score", "alt_bpm")] == pytest.approx([cut[name][c] for c in ("bpm", "beat0", "score", "alt_bpm")])


def test_grid_fit_measures_a_late_pulse(spark):
    onsets = settle(rows(spark, s=clicks(120.0)))
    beats = spark.createDataFrame([("s", 0.28 + 0.5 * k, k // 4 + 1) for k in range(78)], "series_id string, t double, bar long")
    fit = [r for r in G.grid_fit(onsets, beats, KEYS, "value").collect() if r["offset_ms"] is not None]
    assert len(fit) >= 2 and all(r["offset_ms"] == pytest.approx(20, abs=3) for r in fit)


def test_bar_lines_follow_meters_and_pickups(spark):
    meters = spark.createDataFrame([("s", 0.0, 4, 4, 1.0), ("s", 9.0, 3, 4, 1.0), ("s", 15.0, 6, 8, 1.5)], "series_id string, q double, num int, den int, pulse double")
    spans = spark.createDataFrame([("s", -5.0, 21.0, 0.0)], "series_id string, q_from double, q_to double, anchor double")
    got = sorted((r["bar"], r["q"], r["length"]) for r in G.bar_lines(meters, spans, KEYS, size=4).collect())
    assert got == [(-1, -8.0, 4.0), (0, -4.0, 4.0), (1, 0.0, 4.0), (2, 4.0, 4.0), (3, 8.0, 1.0), (4, 9.0, 3.0), (5, 12.0, 3.0),
                   (6, 15.0, 3.0), (7, 18.0, 3.0), (8, 21.0, 3.0)]


def test_impulses_land_where_they_were_moved(spark):
    rng = np.random.default_rng(9)
    times = np.sort(rng.uniform(2, 28, size=60))
    weights = rng.uniform(0.3, 1.0, size=60)
    onset = np.zeros(3000)
    for t, w in zip(times + 1.237, weights):
        p = t * 100
        onset[int(p)] += w * (1 - p % 1)
        onset[int(p) + 1] += w * (p % 1)
    audio = settle(rows(spark, s=np.convolve(onset, np.ones(3) / 3, "same")))
    hits = spark.createDataFrame([("s", float(t), float(w)) for t, w in zip(times, weights)], "series_id string, t double, weight double")
    found = N.impulse_align(hits, audio, KEYS, "value", search_s=5.0, size=700).collect()[0]
    assert found["offset_s"] == pytest.approx(1.237, abs=0.003) and found["sure"] and found["r"] > 0.95


def test_shifted_trains_equal_trains_drawn_impulse_by_impulse(spark):
    rng = np.random.default_rng(2)
    hits = [("s", float(t), float(w)) for t, w in zip(np.round(rng.uniform(-4, 44, 70), 2), rng.uniform(0.2, 1, 70))] + [("other", 5.0, 1.0)]
    heard = [("s", i, None if i == 9 else float(rng.normal())) for i in range(40)]
    impulses = spark.createDataFrame(hits, "series_id string, t double, weight double")
    audio = spark.createDataFrame(heard, "series_id string, frame long, v double")
    # Blocks of 16 frames: trains reach over their edges, and past the last block that has a frame of its own.
    got = {r.step: r for r in N.shifted_moments(impulses.withColumnRenamed("t", "at"), audio, KEYS, 20, 20, 16).collect()}
    levels = {i: v for _, i, v in heard}
    assert sorted(got) == list(range(-20, 21))
    for step in (-20, -7, 0, 1, 13, 20):
        train = {r.frame: r.train for r in N.impulse_train(impulses.where("series_id = 's'"), KEYS, 1.0, F.lit(step * 0.05)).collect()}
        want = (sum(train.values()), sum(v * v for v in train.values()), sum(v * (levels[f] or 0.0) for f, v in train.items() if f in levels),
                sum(v for f, v in train.items() if f in levels))
        assert tuple(got[step])[2:] == pytest.approx(want)


def test_sample_measures_match_one_pass(spark):
    sr, n = 8000, 24000
    rng = np.random.default_rng(3)
    x = (0.5 * np.sin(2 * np.pi * 220 * np.arange(n) / sr) + 0.05 * rng.normal(size=n)).astype(np.float32)
    frame = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, i long, l double")
    blocks = settle(A.sample_blocks(frame, KEYS, "i", "l", 5000))
    fine = {r["frame"]: r for r in A.measure(blocks, KEYS, sr, frames_per_block=37).collect()}
    whole = {r["frame"]: r for r in A.measure(blocks, KEYS, sr, frames_per_block=4096).collect()}
    assert len(fine) == len(whole) == 1 + n // 80
    for f in (0, 1, 36, 37, 38, 150, 300):
        for name in ("rms_ms", "lowmid_ms", "flux", "tempo_flux", "cent"):
            assert fine[f][name] == pytest.approx(whole[f][name], rel=2e-4, abs=1e-6), (f, name)
    assert whole[150]["lowmid_ms"] == pytest.approx(0.125, rel=0.05)


def test_fine_lag_is_found_to_the_sample(spark):
    sr, n = 8000, 20000
    x = np.random.default_rng(5).normal(size=n)
    table = lambda shift: settle(A.sample_blocks(spark.createDataFrame(
        [("s", i + shift, float(v)) for i, v in enumerate(x)], "series_id string, i long, l double"), KEYS, "i", "l", 3000))
    spans = spark.createDataFrame([("s", 0, n)], "series_id string, first long, last long")
    coarse = spark.createDataFrame([("s", 0.01)], "series_id string, lag_s double")
    segments = A.fine_segments(table(0), table(90), coarse, spans, KEYS, sr, length=4096)
    assert L.fine_lag(segments, coarse, KEYS, sr).collect()[0]["lag_s"] == pytest.approx(90 / sr, abs=1e-4)


def test_group_settles_repeaters_and_refuses_outliers(spark):
    lags = np.arange(-30, 31)
    peak = lambda at, h=0.9: h * np.exp(-((lags - at) ** 2) / 4.0)
    curves = {"drums": peak(5), "bass": peak(5), "keys": peak(5, 0.8), "loop": np.maximum(peak(5, 0.7), peak(-20, 0.72)), "other": peak(-12), "noise": peak(3, 0.1)}
    df = spark.createDataFrame([("song", m, int(k), float(r)) for m, rs in curves.items() for k, r in zip(lags, rs)], "song string, stem string, lag int, r double")
    got = {r["stem"]: (r["status"], r["lag_s"]) for r in L.align_group(df, ["song"], "stem").collect()}
    assert got["drums"] == ("auto", 0.05) and got["loop"] == ("auto", pytest.approx(0.05, abs=0.002))
    assert got["other"][0] == "refused" and got["noise"][0] == "refused"


def test_contract_of_members(spark):
    lags = np.arange(-30, 31)
    peak = lambda at, h=0.9: h * np.exp(-((lags - at) ** 2) / 4.0)
    curves = {"drums": peak(5), "bass": peak(5), "keys": peak(5, 0.8), "other": peak(-12), "noise": peak(3, 0.1), "told": peak(5), "far": peak(30, 0.5), "long": peak(5)}
    df = spark.createDataFrame([("song", m, int(k), float(r)) for m, rs in curves.items() for k, r in zip(lags, rs)], "song string, stem string, lag int, r double")
    given = spark.createDataFrame([("song", "told", 0.25)], "song string, stem string, lag_s double")
    sizes = spark.createDataFrame([("song", m, 2000 if m == "long" else 950) for m in [*curves, "hush"]], "song string, stem string, samples long")
    masters = spark.createDataFrame([("song", 1000)], "song string, length long")
    got = {r.stem: r for r in L.group_contract(L.align_group(df, ["song"], "stem", given), sizes, masters, ["song"], "stem", 1000.0).collect()}
    assert {m: r.source for m, r in got.items()} == {"drums": "auto", "bass": "auto", "keys": "auto", "long": "auto", "other": "refused", "noise": "refused",
                                                     "far": "refused", "told": "given", "hush": "none"}
    assert (got["drums"].lag_s, got["drums"].gap_s, got["drums"].problem, got["drums"].warning) == (0.05, 0.0, None, None)
    assert (got["hush"].lag_s, got["hush"].gap_s) == (0.0, -0.05)
    assert got["long"].problem == "ends 1.05 s after its master" and got["told"].lag_s == 0.25 and "+0.050" in got["told"].warning
    assert "the other members at +0.050" in got["other"].problem and "hardly" in got["noise"].problem and "edge" in got["far"].problem


def test_a_voice_replaces_its_proxy(spark):
    levels = spark.createDataFrame([(s, f, v) for s, v in (("sung", 0.5), ("proxy", 0.25), ("mono", None)) for f in range(2)], "song string, frame long, voc double")
    members = spark.createDataFrame([("sung", "Vox", 0, 0.9), ("sung", "drums", 0, 0.1), ("sung", "voice", 0, 0.7), ("proxy", "bass", 0, 1.0)], "song string, stem string, frame long, rms double")
    got = {(r.song, r.frame): (r.voc, r.voc_source) for r in L.with_voice(levels, members, ["song"], "stem", "rms").collect()}
    assert got == {("sung", 0): (0.9, "stem"), ("sung", 1): (0.0, "stem"), ("proxy", 0): (0.25, "mid-side proxy"), ("proxy", 1): (0.25, "mid-side proxy"),
                   ("mono", 0): (None, None), ("mono", 1): (None, None)}


def test_members_line_up_from_samples(spark):
    sr, n = 8000, 8000 * 8
    rng = np.random.default_rng(11)
    gate = lambda seed, period: np.repeat((np.random.default_rng(seed).random(n // period) < 0.4).astype(float), period)
    voice = np.sin(2 * np.pi * 440 * np.arange(n) / sr) * gate(1, 800)
    drums = rng.normal(size=n) * gate(2, 400)
    mix = voice + drums
    late = 2400  # the mix starts 0.3 s into the session

    def table(**parts):
        rows = [("song", k, i, float(v)) for k, vs in parts.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "song string, stem string, i long, l double")

    stems = settle(A.sample_blocks(table(voice=voice, drums=drums), ["song", "stem"], "i", "l", 4000))
    master = settle(A.sample_blocks(table(mix=mix[late:]).drop("stem"), ["song"], "i", "l", 4000))
    got = settle(A.align_members(stems, master, ["song"], "stem", sr, search_s=0.6, frames_per_block=200))
    lags = {r["stem"]: (r["status"], r["lag_s"]) for r in got.collect()}
    assert lags["voice"] == ("auto", pytest.approx(-0.3, abs=0.006)) and lags["drums"] == ("auto", pytest.approx(-0.3, abs=0.006))
    lengths = master.groupBy("song").agg({"start_sample": "max"}).selectExpr("song", f"CAST({n - late} AS BIGINT) AS length")
    moved = settle(A.lined_up_blocks(stems, got, lengths, ["song", "stem"], ["song"], sr))
    levels = A.raw_levels(A.measure(moved, ["song", "stem"], sr, 256), ["song", "stem"])
    assert levels.groupBy("stem").count().collect()[0]["count"] == 1 + (n - late) // 80


def test_member_curves_are_those_of_bands_as_rows_and_store_no_frame(spark, monkeypatch):
    """Over several spans, with stereo members, a gap, a late start, a silent member and one that outlasts its master; the bands of frames take no disk."""
    rng = np.random.default_rng(12)
    n, sr, reach = 9000, 800, 15
    voice, noise = (np.sin(np.arange(n) / 2.1) * np.repeat(rng.random(n // 100) < 0.5, 100), rng.normal(size=n) * np.repeat(rng.random(n // 60) < 0.4, 60))
    parts = {"voice": [(i, float(voice[i]), float(voice[i] / 2 + noise[i] / 9)) for i in range(n)], "noise": [(i, float(noise[i]), float(noise[i])) for i in range(1400, n) if not 4200 <= i < 4900],
             "mute": [(i, 0.0, 0.0) for i in range(n)], "long": [(i, float(voice[i % n]), 0.0) for i in range(n + 2500)]}
    rows = spark.createDataFrame([("s", k, *r) for k, v in parts.items() for r in v], "song string, stem string, i long, l double, r double")
    mixed = spark.createDataFrame([("s", i, float(voice[i + 50] + noise[i + 50])) for i in range(n - 50)], "song string, i long, l double")
    keys = ["song", "stem"]
    members, masters = settle(A.sample_blocks(rows, keys, "i", "l", 700, "r")), settle(A.sample_blocks(mixed, ["song"], "i", "l", 512))

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    stored = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    before = stored()
    monkeypatch.setattr(A, "discard", lambda *settled: None)
    got = [settle(c) for c in A.member_curves(members, masters, ["song"], "stem", sr, reach, 64, 200)]
    A.align_members(members, masters, ["song"], "stem", sr, reach / 100, frames_per_block=64)
    assert stored() - before < 16 * rows.count()  # a frame's twenty bands, by two measures, would be 40 bytes a sample

    whole = A.alignment_bands(masters, ["song"], sr, 200).select("song", "frame", "band", F.col("power").alias("_mp"), F.col("onset").alias("_mo"))
    part = A.alignment_bands(members, keys, sr, 200)
    both = settle(part.join(whole.join(part.select(*keys).distinct(), ["song"]), [*keys, "frame", "band"], "full"))
    for curve, (value, ref, weight) in zip(got, (("power", "_mp", "energy"), ("onset", "_mo", "variance"))):
        want = {(r.stem, r.lag): r.r for r in L.band_correlation(both, keys, reach, value, ref, weight).collect()}
        have = {(r.stem, r.lag): r.r for r in curve.collect()}
        assert have.keys() == want.keys() and {k for k, _ in want} == {"voice", "noise", "long"}
        assert have == pytest.approx(want, abs=1e-6)
