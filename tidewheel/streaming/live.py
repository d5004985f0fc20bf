"""The streaming operators: levels, windows, gain, smoothing, scaling, delay, passages, loops."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewheel.constants import FLUX_CEILING
from tidewheel.functions import scalar as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """Stateful processors keep their state in RocksDB, checkpointed with the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def stream_levels(events: DataFrame, series: str, ts: str, value: str, hop: str, half_hop: str, delay: str) -> DataFrame:
    """Frame levels as they close: frame i covers half a hop either side of its time."""
    window = F.window(ts, hop, hop, half_hop)
    return (events.withWatermark(ts, delay).groupBy(series, window).agg(
        F.count(value).alias("n"), F.sum(value).alias("value"), F.avg(F.col(value) * F.col(value)).alias("_ms"))
        .select(series, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "value", S.to_db(F.col("_ms")).alias("rmsdb")))


def stream_windows(events: DataFrame, series: str, ts: str, value: str, width: str, step: str, delay: str) -> DataFrame:
    """Sliding comparison windows as they close."""
    return (events.withWatermark(ts, delay).groupBy(series, F.window(ts, width, step)).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))
        .select(series, F.col("window.start").alias("start"), "n", "mean", "spread"))


def stream_quiet(levels: DataFrame, series: str, ts: str, db: str, threshold: float, hop_seconds: float, min_seconds: float, delay: str) -> DataFrame:
    """Quiet passages as they close: a run ends one hop after its last quiet frame."""
    hop = f"{int(hop_seconds * 1000)} milliseconds"
    quiet = levels.withWatermark(ts, delay).where(F.col(db) < threshold)
    runs = quiet.groupBy(series, F.session_window(ts, hop).alias("w")).agg(
        F.avg(db).alias("mean_db"), F.count("*").alias("frames"), F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    # The length comes from the aggregates: a condition on the session itself would be pushed below
    # the merge and test single rows.
    length = F.unix_micros("_last") - F.unix_micros("_first") + hop_seconds * 1e6
    return runs.where(length >= min_seconds * 1e6).select(series, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean_db", "frames")


def scale_live(frames: DataFrame, scales: DataFrame, series: str, value: str, out: str, ceiling: float = FLUX_CEILING) -> DataFrame:
    """A stream on the scale of its pre-scan: value over the series' reference, clipped."""
    ref = F.col("reference")
    return frames.join(scales.select(series, "reference"), series).withColumn(
        out, F.when(ref > 0, S.clamp(F.col(value) / ref, 0.0, ceiling)).otherwise(0.0)).drop("reference")


HELD = pa.schema([("series", pa.string()), ("at", pa.int64()), ("frame", pa.int64()), ("value", pa.float64())])


def _stored(rows: pd.DataFrame) -> bytes:
    """Rows of many series as one state value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(pa.Table.from_pandas(rows, schema=HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _read(stored: bytes | None) -> pd.DataFrame:
    return (HELD.empty_table() if stored is None else pa.ipc.open_stream(bytes(stored)).read_all()).to_pandas()


class InOrder(StatefulProcessor):
    """Frames of each series in event-time order, whatever order they came in.

    A key is a lane of many series (see run_processor), so that a batch costs one call and two state accesses a lane and not a series.
    Frames wait in state until the watermark has passed them; a timer at the earliest one waiting makes sure that they come out
    even if the lane falls silent. `step` then gets those of one series sorted, with the rows it kept of that series. What waits is what
    the watermark's delay and the newest batch hold, so neither the state nor a call grows with the stream. Frames behind the watermark
    are dropped by Spark and counted in the query's progress (see run_available).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "waiting binary, kept binary")

    def step(self, known: np.ndarray, kept: np.ndarray, frames: np.ndarray, values: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """A series' kept frames and values, and those that are due -> output columns, and what to keep in place of the first two."""
        raise NotImplementedError

    def shaped(self, out: pd.DataFrame) -> pd.DataFrame:
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [pd.DataFrame({"series": b["series"], "at": b["ts"].astype("datetime64[ms]").astype("int64"), "frame": b["frame"].astype("int64"),
                              "value": b["value"].astype("float64")}) for b in rows]
        yield from self.released(came, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.released([], timerValues)

    def released(self, came: list[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.held.get() or (None, None)
        rows = pd.concat([_read(stored[0]), *came], ignore_index=True)
        late = rows["at"] > timerValues.getCurrentWatermarkInMs()
        due, rest = rows[~late], rows[late]
        if len(rest):
            self.handle.registerTimer(int(rest["at"].min()))
        if due.empty:
            if came:
                self.held.update((_stored(rest), stored[1]))
            return
        out, kept = self.stepped(_read(stored[1]), due)
        self.held.update((_stored(rest), _stored(kept)))
        yield out

    def stepped(self, kept: pd.DataFrame, due: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """`step` for each series that has rows due; the others keep what they kept."""
        both = pd.concat([kept, due], ignore_index=True)
        series, names = pd.factorize(both["series"], use_na_sentinel=False)
        fresh = np.arange(len(both)) >= len(kept)
        order = np.lexsort((both["value"], both["frame"], both["at"], fresh, series))
        frame, value = both["frame"].to_numpy()[order], both["value"].to_numpy()[order]
        ends = np.cumsum(np.bincount(series, minlength=len(names)))
        begins = ends - np.bincount(series, minlength=len(names))
        starts = begins + np.bincount(series[~fresh], minlength=len(names))
        columns, counts, held = [], np.zeros(len(names), dtype=np.int64), []
        for k, (begin, start, end) in enumerate(zip(begins, starts, ends)):
            keep = frame[begin:start], value[begin:start]
            if end > start:
                got, *keep = self.step(*keep, frame[start:end], value[start:end])
                columns.append({"frame": frame[start:end], **got})
                counts[k] = end - start
            held.append(keep)
        out = pd.DataFrame({"series_id": np.repeat(names, counts), **{c: np.concatenate([g[c] for g in columns]) for c in columns[0]}})
        return self.shaped(out), pd.DataFrame({"series": np.repeat(names, [len(f) for f, _ in held]), "at": 0, "frame": np.concatenate([f for f, _ in held]),
                                               "value": np.concatenate([v for _, v in held])})

    def close(self) -> None:
        pass


class AutoGain(InOrder):
    """value over a decaying running maximum; frames that never came still decay it. Keeps the last frame with its peak."""

    def __init__(self, decay: float = 0.9995, start: float = 1e-3):
        self.decay, self.floor = decay, start

    def step(self, known, kept, frames, values):
        peak, last = (kept[-1], known[-1]) if len(known) else (self.floor, -1)
        # In logarithms the decay is a slope, and the peak a running maximum over it.
        fall = math.log(self.decay) * (frames - last)
        logs = np.log(np.where(values > 0, values, 1e-300))
        peaks = np.exp(np.maximum(np.maximum.accumulate(logs - fall), math.log(peak)) + fall)
        return {"gain_ref": peaks, "gain": np.clip(values / peaks, 0.0, 1.0)}, frames[-1:], peaks[-1:]


class SmoothAndFlux(InOrder):
    """Exponential smoothing and the rectified step from the smoothed frame before. Keeps the last frame with its level."""

    def __init__(self, tau: float = 0.55):
        self.tau = tau

    def step(self, known, kept, frames, values):
        level = float(kept[-1]) if len(known) else 0.0
        levels = np.array(list(accumulate(values.tolist(), lambda held, v: self.tau * held + (1.0 - self.tau) * v, initial=level)))
        flux = np.maximum(np.diff(levels), 0.0)
        if not len(known):
            flux[0] = 0.0
        return {"smooth": levels[1:], "flux": flux}, frames[-1:], levels[-1:]


class DelayedFrame(InOrder):
    """Each frame answered with the frame heard `latency` seconds before it, from a short ring, which is what it keeps."""

    def __init__(self, latency: float, fps: float, keep_s: float = 4.0):
        self.latency, self.fps, self.keep = min(max(latency, 0.0), 1.0), fps, keep_s

    def step(self, known, kept, frames, values):
        known, heard = np.concatenate([known, frames]), np.concatenate([kept, values])
        place = np.searchsorted(known, frames - self.latency * self.fps + 1e-9, side="right") - 1
        there = (place >= 0) & (known[np.maximum(place, 0)] >= frames - self.keep * self.fps)
        place = np.maximum(place, 0)
        ring = known >= frames[-1] - self.keep * self.fps
        return {"heard": known[place], "value": heard[place], "there": there}, known[ring], heard[ring]

    def shaped(self, out):
        there = out.pop("there")
        return out.assign(heard=out["heard"].astype("Int64").where(there), value=out["value"].astype("Float64").where(there))


class LoopHits(StatefulProcessor):
    """Hits of a looped track in loop time, each once; hits of a loop before the newest one heard are dropped. A key is a lane of series."""

    def __init__(self, loop_s: float):
        self.loop = loop_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "loops binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heard = _read((self.newest.get() or (None,))[0])
        # Each series' hits in time order, after the newest loop heard of it.
        hits = pd.concat(rows, ignore_index=True).sort_values("t", kind="stable")
        hits["frame"] = np.floor((hits["t"] + 1e-6) / self.loop).astype("int64")
        loops = pd.concat([heard[["series", "frame"]], hits[["series", "frame"]]], ignore_index=True).groupby("series", dropna=False, sort=False)["frame"]
        kept = hits[hits["frame"].to_numpy() >= loops.transform("first").to_numpy()[len(heard):]]
        self.newest.update((_stored(loops.max().reset_index().assign(at=0, value=0.0)),))
        yield pd.DataFrame({"series_id": kept["series"], "t": kept["t"] - kept["frame"] * self.loop, "strength": kept["strength"], "loop": kept["frame"]})

    def close(self) -> None:
        pass


OUTPUTS = {
    AutoGain: "series_id string, frame long, gain_ref double, gain double",
    SmoothAndFlux: "series_id string, frame long, smooth double, flux double",
    DelayedFrame: "series_id string, frame long, heard long, value double",
    LoopHits: "series_id string, t double, strength double, loop long",
}


def run_processor(frames: DataFrame, processor: StatefulProcessor, series: str = "series_id", mode: str = "Append",
                  delay: str = "0 seconds", hop_ms: int = 10, lanes: int = 256) -> DataFrame:
    """Apply a stateful processor to each series of a stream, a lane of them (by hash) at a time: a lane's series share one state value and one
    call a batch, so `lanes` is to grow with the series. Processors in event-time order need `ts`, else a frame (from 0 on) ends `hop_ms` after
    the one before; time 0 is behind any watermark."""
    name = F.col(series).cast("string")
    lane = F.pmod(F.xxhash64(name), F.lit(lanes)).cast("int").alias("lane")
    if not isinstance(processor, InOrder):
        return frames.select(lane, name.alias("series"), "t", "strength").groupBy("lane").transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=OUTPUTS[type(processor)], outputMode=mode, timeMode="None")
    timed = frames if "ts" in frames.columns else frames.withColumn("ts", F.timestamp_millis((F.col("frame") + 1) * hop_ms))
    return timed.withWatermark("ts", delay).select(lane, name.alias("series"), "ts", "frame", "value").groupBy("lane").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUTS[type(processor)], outputMode=mode, timeMode="EventTime")


class LateRows(StreamingQueryListener):
    """Counts the rows that a query's watermark dropped, from the progress of every batch."""

    def __init__(self) -> None:
        self.count, self.over = 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.count += sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.over.set()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Process what is there and stop; started again with the same checkpoint it goes on exactly
    where it stopped and writes nothing twice. Returns how many rows came behind the watermark and were dropped."""
    streams, late = stream.sparkSession.streams, LateRows()
    streams.addListener(late)
    try:
        (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
        late.over.wait(30)  # progress is reported in another thread, the end last
    finally:
        streams.removeListener(late)
    return late.count


def run_parts(parts: Iterable[DataFrame], folder: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Feed a stream part by part, with a stop after each, as a job that is restarted again and again; its output and late rows.

    Event-time results come out as the watermark passes them: the last part needs a time that closes what is open (`closing`).
    """
    late = 0
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = build(part.sparkSession.readStream.schema(part.schema).parquet(f"{folder}/in"))
        late += run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return part.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), late


def run_closed(build: Callable[[], DataFrame], folder: str, end: DataFrame) -> DataFrame:
    """Run a stream over what is there, then over one more row (`end`) that its second source finds in `folder`/end: the watermark passes
    all windows with it, so those open at the end of the data come out too."""
    end.limit(0).write.parquet(f"{folder}/end")
    stream = build()
    run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    end.write.mode("append").parquet(f"{folder}/end")
    run_available(build(), f"{folder}/out", f"{folder}/checkpoint")
    return end.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def closing(frames: DataFrame, ahead: int) -> DataFrame:
    """One row, `ahead` frames past the last and of no series: after the part that holds it the watermark has passed all others."""
    last = frames.agg(F.max("frame").alias("frame"))
    return last.select(*[(F.col("frame") + ahead if f.name == "frame" else F.lit("" if f.name == "series_id" else None)).cast(f.dataType).alias(f.name) for f in frames.schema])
