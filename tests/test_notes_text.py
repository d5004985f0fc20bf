"""Notes, chords, texts and plans against sequential brute force."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import chords as H
from tidewheel.functions import text as X
from tidewheel.operators import extend as E
from tidewheel.operators import notes as N
from tidewheel.operators import synth as Y
from tidewheel.session import settle

TRACK = ["track"]


def events(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choices(["on", "off", "pedal"], [5, 5, 1])[0]
        value = rng.choice([0, 127]) if kind == "pedal" else rng.choice([0, 60, 90]) if kind == "on" else 0
        out.append((rng.choice("ab"), i, i * 10, kind, rng.choice([0, 1]), rng.choice([60, 62, 64]), value))
    return out


def test_pairing_and_sustain_match_a_queue(spark):
    rows = events()
    df = spark.createDataFrame(rows, "track string, seq long, tick long, kind string, channel int, pitch int, value int")
    notes = settle(N.pair_notes(df, TRACK, size=16))
    got = sorted((r["track"], r["on_seq"], r["end_tick"]) for r in N.sustain(notes, df, TRACK, bucket=16.0).collect())
    want = []
    for track in "ab":
        mine = [r for r in rows if r[0] == track]
        end, queues, held, down = mine[-1][2], {}, {}, {}
        for _, seq, tick, kind, ch, pitch, value in mine:
            if kind == "pedal":
                if down.get(ch) and value < 64:
                    for p in [k for k in held if k[0] == ch]:
                        want += [(track, s, tick) for s in held.pop(p)]
                down[ch] = value >= 64
            elif kind == "on" and value > 0:
                want += [(track, s, tick) for s in held.pop((ch, pitch), [])]
                queues.setdefault((ch, pitch), deque()).append(seq)
            elif queues.get((ch, pitch)):
                s = queues[ch, pitch].popleft()
                if down.get(ch):
                    held.setdefault((ch, pitch), []).append(s)
                else:
                    want.append((track, s, tick))
        want += [(track, s, end) for q in [*held.values(), *queues.values()] for s in q]
    assert got == sorted(want)


@pytest.mark.parametrize("inclusive", [True, False])
def test_clusters_are_anchored(spark, inclusive):
    rng = random.Random(3)
    t, rows = 0.0, []
    for _ in range(150):
        t = round(t + rng.choice([0.004, 0.011, 0.02, 0.05]), 3)
        rows.append(("a", t, 60))
    df = spark.createDataFrame(rows, "track string, t double, pitch int")
    got = {r["t"]: r["cluster"] for r in N.onset_clusters(df, TRACK, 0.02, inclusive, bucket=0.3, size=8).collect()}
    anchor = None
    for _, at, _ in rows:
        if anchor is None or (at - anchor > 0.02 if inclusive else at - anchor >= 0.02):
            anchor = at
        assert got[at] == anchor


def test_sounding_counts_held_notes_once(spark):
    rng = random.Random(8)
    rows = [("a", round(rng.uniform(0, 6), 2), round(rng.uniform(0.05, 1.5), 2), rng.choice([48, 52, 55, 59])) for _ in range(60)]
    df = spark.createDataFrame(rows, "track string, t double, dur double, pitch int")
    got = {r["t"]: r["pitches"] for r in N.sounding_clusters(df, TRACK, bucket=0.5).collect()}
    ordered = sorted((t, p, t + d) for _, t, d, p in rows)
    i, seen = 0, {}
    while i < len(ordered):
        start = ordered[i][0]
        j = i
        while j < len(ordered) and ordered[j][0] - start < 0.03:
            j += 1
        seen[start] = sorted({p for _, p, _ in ordered[i:j]} | {p for _, p, e in ordered[:i] if e > start + 0.03})
        i = j
    assert got == seen


@pytest.mark.parametrize("pitches,key,name", [
    ([60, 64, 67], None, "C"), ([57, 60, 64], None, "Am"), ([55, 59, 62, 65], None, "G7"), ([50, 55, 57], None, "Dsus4"),
    ([52, 60, 67], None, "C/E"), ([55, 65, 69, 72], None, "F/G"), ([60, 64, 67, 69], None, "C6"), ([59, 60, 64, 67], None, "C/B"),
    ([52, 59], None, "E5"), ([60, 62], None, None), ([60], None, None), ([60, 61, 62], None, "?"), ([54, 58, 61], None, "F#"),
    ([54, 58, 61], -5, "Gb"), ([58, 62, 65], 1, "Bb"), ([58, 62, 65], 5, "A#"), ([40, 52, 59, 64], None, "E5"),
])
def test_chord_names(spark, pitches, key, name):
    df = spark.createDataFrame([(pitches, key)], "p array<int>, k int")
    assert df.select(H.chord_name(F.col("p"), F.col("k"))).first()[0] == name


def test_chord_changes_skip_short_and_repeated(spark):
    notes = [(0.0, 1.0, p) for p in (60, 64, 67)] + [(1.0, 0.1, p) for p in (57, 60, 64)] + [(1.1, 0.9, p) for p in (60, 64, 67)] + [(2.0, 2.0, p) for p in (53, 57, 60)]
    df = spark.createDataFrame([("t", a, d, p) for a, d, p in notes], "track string, t double, dur double, pitch int")
    named = settle(N.named_clusters(N.sounding_clusters(df, TRACK), TRACK))
    tempos = spark.createDataFrame([("t", 0.0, 0.0, 120.0)], "track string, quarters double, seconds double, bpm double")
    got = sorted((r["t"], r["until"], r["chord"]) for r in N.chord_changes(named, df, tempos, TRACK, TRACK).collect())
    assert got == [(0.0, 2.0, "C"), (2.0, 4.0, "F")]


def test_unique_suffixes_skip_taken_names(spark):
    names = ["x", "x", "x-2", "x", "y", "x-2", "y", "z-3"]
    df = spark.createDataFrame([("g", n, i) for i, n in enumerate(names)], "g string, n string, i long")
    got = [r["u"] for r in sorted(X.unique_suffixes(df, ["g"], "n", "i", "u", salt_size=3).collect(), key=lambda r: r["i"])]
    taken, want = set(), []
    for n in names:
        k, c = 1, n
        while c in taken:
            k += 1
            c = f"{n}-{k}"
        taken.add(c)
        want.append(c)
    assert got == want


def test_text_helpers(spark):
    df = spark.createDataFrame([("Bajo Eléctrico!", "كتاب ABC x ي", '{"a": ["/srv/x/y", "ok"], "b.wav": {"c": "host7"}}')], "n string, f string, j string")
    r = df.select(X.slug(F.col("n")).alias("s"), X.persian(F.col("f"), ["x ي"]).alias("p")).first()
    assert r["s"] == "bajo-electrico"
    assert r["p"] == "کتاب ⁨ABC x⁩ ي"
    documents = [(1, '{"a": ["/srv/x/y", "ok", 7, null], "b.wav": {"c": "host7"}, "z": {"y": {"x": [["~/deep"]]}}}'), (2, "see /srv/x/y"), (3, None), (4, "[]")]
    found = X.leaks(spark.createDataFrame(documents, "id int, j string"), ["id"], "j", ["HOST7"]).collect()
    assert {tuple(x) for x in found} == {(1, "$.a[0]", "looks like a path"), (1, "${key #2}", "names a file"), (1, "${#2}.c", "holds private token #1"),
                                         (1, "$.z.y.x[0][0]", "looks like a path"), (2, "$", "looks like a path")}


def test_link_rule_knows_letters_of_any_script(spark):
    df = spark.createDataFrame([("see café.com",), ("see plain.com",), ("WWW.x",), ("no link",)], "t string")
    assert [r[0] for r in df.select(X.rule_breaks(F.col("t"))).collect()] == [["a link"], ["a link"], ["a link"], []]


def test_closest_names(spark):
    known = spark.createDataFrame([("tiktok",), ("youtube",), ("spotify-canvas",)], "id string")
    got = X.closest(spark.createDataFrame([("tictok",), ("zzz",)], "w string"), known, "w", "id").collect()
    assert {r["w"]: r["closest"] for r in got} == {"tictok": ["tiktok"], "zzz": []}


def test_level_map_meets_its_level(spark):
    rng = random.Random(4)
    values = [rng.random() ** 3 for _ in range(2000)]
    df = spark.createDataFrame([("s", 0, i, v) for i, v in enumerate(values)], "series_id string, section int, frame long, value double")
    want = spark.createDataFrame([("s", 0, 0.2, 0.6, 0.9)], "series_id string, section int, mean double, p95 double, max double")
    out = [(r["value"], r["level"]) for r in Y.level_map(df, want, ["series_id", "section"], "value", "level").collect()]
    levels = sorted(l for _, l in out)
    assert sum(levels) / len(levels) == pytest.approx(0.2, abs=0.01)
    assert levels[-1] == pytest.approx(0.9) and levels[int(0.95 * 1999)] == pytest.approx(0.6, abs=0.02)
    assert [l for _, l in sorted(out)] == pytest.approx(levels)


def test_level_map_of_ties_flats_and_low_peaks(spark):
    schema = "series_id string, section int, frame long, value double"
    rows = [("tied", 0, i, 0.0 if i < 970 else 0.5 + i / 5000) for i in range(1000)] + [("flat", 0, i, 0.4) for i in range(9)]
    rows += [("low", 0, i, i / 100) for i in range(101)]
    want = [("tied", 0, 0.2, 0.6, 0.9), ("flat", 0, 0.3, 0.6, 0.9), ("low", 0, 0.3, 0.8, 0.5)]
    got = {}
    for r in Y.level_map(spark.createDataFrame(rows, schema), spark.createDataFrame(want, "series_id string, section int, mean double, p95 double, max double"),
                         ["series_id", "section"], "value", "level").collect():
        got.setdefault(r["series_id"], []).append((r["value"], r["level"]))
    assert len(got["tied"]) == 1000 and sum(l for _, l in got["tied"]) / 1000 == pytest.approx(0.2, abs=0.002)
    assert max(got["tied"])[1] == pytest.approx(0.9) and min(l for v, l in got["tied"] if v > 0) == pytest.approx(0.6)
    assert {l for _, l in got["flat"]} == {0.3}
    levels = [l for _, l in sorted(got["low"])]
    assert levels == sorted(levels) and levels[-1] == pytest.approx(0.8)


def test_user_program_keeps_state_between_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.createDataFrame([("s", i, float(i)) for i in range(40)], "k string, i long, v double")

    def step(state, pdf):
        total = pdf["v"].cumsum() + state[0]
        state[0] = total.iloc[-1]
        return pdf[["k", "i"]].assign(total=total)

    got = {r["i"]: r["total"] for r in E.run_program(df, ["k"], "i", lambda: [0.0], step, "k string, i long, total double").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {i: i * (i + 1) / 2 for i in range(40)}


def test_section_fit_sums_only_the_stretches_that_may_be_best():
    """A slow grid has thousands of slides to a beat: the answer is that of all stretches' sums, most of which aren't made."""
    import numpy as np

    from tidewheel.functions import kernels as K

    rng, made = np.random.default_rng(3), []
    plain = K._pulse_row
    for case in range(8):
        beats, onset = np.arange(32) * 8.0, rng.random(250 + case) ** 8
        onset[np.rint(beats[:30] * (1 + 0.004 * case) + 1.5).astype(int) % len(onset)] += 2.0
        stretches, slides, energy = K.pulse_energy(onset, 0, beats, 1.0)
        tops = energy.max(axis=1)
        row = int(tops.argmax()) if tops.max() > K.STRETCH_GAIN * tops[K.STRETCHES] else K.STRETCHES
        try:
            K._pulse_row = lambda *a: made.append(1) or plain(*a)
            got = K.section_fit(onset, 0, beats, 1.0, 0.0, 1 / 48)
        finally:
            K._pulse_row = plain
        assert got[:2] == (stretches[row], slides[energy[row].argmax()])
    assert len(made) <= 8 * 6
