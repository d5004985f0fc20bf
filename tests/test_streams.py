"""Streams: the same answer as the batch operator, over several batches and across a restart."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import series as O
from tidewheel.streaming import live as R


SCHEMA = "series_id string, frame long, value double"


def fed(spark, parts, processor, delay):
    """Output rows and late count of a processor fed part by part, in the order of the lists, with a restart after each."""
    R.stateful_session(spark)
    frames = [spark.createDataFrame(part, SCHEMA).coalesce(1) for part in parts]
    everything = spark.createDataFrame([r for part in parts for r in part], SCHEMA)
    frames[-1] = frames[-1].unionByName(R.closing(everything, 10_000))
    out, late = R.run_parts(frames, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), lambda s: R.run_processor(s, processor, delay=delay, hop_ms=1000))
    rows = out.collect()
    assert len({(r.series_id, r.frame) for r in rows}) == len(rows)
    return {(r.series_id, r.frame): r for r in rows}, late


def shuffled():
    rng = random.Random(4)
    rows = [(s, i, float((i * 37 + len(s)) % 11) / 3) for s in ("s", "other") for i in range(60) if i not in (20, 21)]
    early = [r for r in rows if r[1] < 30 and not (r[1] >= 22 and r[1] % 2)]
    rest = [r for r in rows if r not in early]
    for part in (early, rest):
        rng.shuffle(part)
    return rows, [early, rest]


def test_gain_out_of_order_and_across_a_restart_equals_batch(spark):
    rows, parts = shuffled()
    got, late = fed(spark, parts, R.AutoGain(decay=0.9), "15 seconds")
    want = O.auto_gain(spark.createDataFrame(rows, SCHEMA), ["series_id"], "value", "gain", decay=0.9, size=8).collect()
    assert late == 0 and {k: r.gain for k, r in got.items()} == pytest.approx({(r.series_id, r.frame): r.gain for r in want})


def test_smoothing_and_delay_out_of_order(spark):
    rows, parts = shuffled()
    smooth, late = fed(spark, parts, R.SmoothAndFlux(0.5), "15 seconds")
    heard, _ = fed(spark, parts, R.DelayedFrame(1.0, 3.0, 2.0), "15 seconds")
    assert late == 0 and len(smooth) == len(heard) == len(rows)
    for s in ("s", "other"):
        mine, level = sorted(r[1:] for r in rows if r[0] == s), 0.0
        known = dict(mine)
        for k, (frame, value) in enumerate(mine):
            before, level = level, 0.5 * level + 0.5 * value
            assert smooth[s, frame].smooth == pytest.approx(level) and smooth[s, frame].flux == pytest.approx(max(level - before, 0.0) if k else 0.0)
            past = max((f for f in known if frame - 6 <= f <= frame - 3), default=None)
            assert (heard[s, frame].heard, heard[s, frame].value) == (past, known.get(past))


def test_late_frames_are_counted_and_leave_the_rest_right(spark):
    rows = [("s", i, 1.0 + i % 5) for i in range(50)]
    held = [r for r in rows if r[1] in (3, 17, 28)]
    parts = [[r for r in rows if r[1] < 30 and r not in held], [r for r in rows if r[1] >= 30] + held]
    got, late = fed(spark, parts, R.AutoGain(decay=0.9), "5 seconds")
    kept = [r for r in rows if r[1] not in (3, 17)]
    want = O.auto_gain(spark.createDataFrame(kept, SCHEMA), ["series_id"], "value", "gain", decay=0.9, size=8).collect()
    assert late == 2 and {k[1]: r.gain for k, r in got.items()} == pytest.approx({r.frame: r.gain for r in want})


def test_nothing_is_written_twice(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "series_id string, frame long, value double"
    spark.createDataFrame([("s", i, 1.0) for i in range(10)], schema).write.parquet(f"{folder}/in")
    for _ in range(3):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("v2", F.col("value") * 2)
        R.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    assert spark.read.parquet(f"{folder}/out").count() == 10
    assert os.path.isdir(f"{folder}/checkpoint")


def test_many_series_are_one_call_a_lane_and_batch(spark):
    R.stateful_session(spark)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    class Counted(R.SmoothAndFlux):
        def handleInputRows(self, key, rows, timerValues):
            with open(f"{folder}/calls", "a") as calls:
                calls.write("x")
            yield from super().handleInputRows(key, rows, timerValues)

    rows = [(None if s == 7 else f"s{s}", i, float((i * 13 + s) % 7)) for s in range(80) for i in range(8)]
    parts = [spark.createDataFrame([r for r in rows if (r[1] < 4) == early], SCHEMA) for early in (True, False)]
    parts[-1] = parts[-1].unionByName(R.closing(spark.createDataFrame(rows, SCHEMA), 10_000))
    R.OUTPUTS[Counted] = R.OUTPUTS[R.SmoothAndFlux]
    out, late = R.run_parts(parts, folder, lambda s: R.run_processor(s, Counted(0.5), delay="15 seconds", hop_ms=1000, lanes=4))
    got, level = {(r.series_id, r.frame): r.smooth for r in out.collect()}, 0.0
    assert late == 0 and len(got) == len(rows) and os.path.getsize(f"{folder}/calls") <= 2 * 4
    for series, frame, value in rows:
        level = 0.5 * (level if frame else 0.0) + 0.5 * value
        assert got[series, frame] == pytest.approx(level)


def test_loops_of_many_series_keep_their_own_newest(spark):
    R.stateful_session(spark)
    schema = "series_id string, t double, strength double"
    parts = [[("a", 1.0, 1.0), ("b", 25.0, 2.0), ("c", 5.0, 3.0)], [("b", 9.0, 4.0), ("a", 12.0, 5.0), ("a", 31.0, 6.0), ("b", 27.0, 7.0), ("d", 3.0, 8.0)]]
    out, _ = R.run_parts([spark.createDataFrame(p, schema).coalesce(1) for p in parts], tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
                         lambda s: R.run_processor(s, R.LoopHits(10.0), lanes=1))
    assert sorted((r.series_id, r.loop, r.t, r.strength) for r in out.collect()) == [
        ("a", 0, 1.0, 1.0), ("a", 1, 2.0, 5.0), ("a", 3, 1.0, 6.0), ("b", 2, 5.0, 2.0), ("b", 2, 7.0, 7.0), ("c", 0, 5.0, 3.0), ("d", 0, 3.0, 8.0)]
