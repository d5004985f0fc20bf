"""Events as signals: pulses, envelopes, additive hits, counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalar as S
from tidewheel.operators.joins import asof_join, interval_join, rank_at


def pulse(times: DataFrame, events: DataFrame, keys: Sequence[str], t: str, event_t: str, out: str = "pulse",
          tau: float = 0.12, lead: float = 0.04, bucket: float = 3600.0) -> DataFrame:
    """1 on an event, decaying as exp(-since/tau); an event up to `lead` ahead already counts."""
    hit = asof_join(times, events.select(*keys, F.col(event_t).alias("_e")), keys, t, "_e", ["_e"], lead, bucket)
    since = F.greatest(F.col(t) - F.col("_e"), F.lit(0.0))
    return hit.withColumn(out, F.coalesce(F.exp(-since / tau), F.lit(0.0))).drop("_e")


def since_last(times: DataFrame, events: DataFrame, keys: Sequence[str], t: str, event_t: str, take: Sequence[str] = (),
               out: str = "since", bucket: float = 3600.0) -> DataFrame:
    """Time since the last event at or before `t` (NULL: none yet) and that event's own columns."""
    right = events.select(*keys, F.col(event_t).alias("_e"), *take)
    hit = asof_join(times, right, keys, t, "_e", ["_e", *take], bucket=bucket)
    return hit.withColumn(out, F.greatest(F.col(t) - F.col("_e"), F.lit(0.0))).drop("_e")


def event_envelope(times: DataFrame, events: DataFrame, keys: Sequence[str], t: str, event_t: str, strength: str,
                   out: str = "level", attack: float = 0.005, decay: float = 0.12) -> DataFrame:
    """The strongest of the recent events' hits at each time; an event past attack + 10*decay is over."""
    keys = list(keys)
    reach = attack + 10 * decay
    live = events.select(*keys, F.col(event_t).cast("double").alias("_e"), F.col(strength).alias("_s"),
                         (F.col(event_t) - 1e-6).alias("_from"), (F.col(event_t) + reach + 1e-12).alias("_to"))
    named = times.withColumn("_at", F.col(t).cast("double"))
    near = interval_join(named, live, keys, "_at", "_from", "_to", reach)
    level = F.col("_s") * S.hit(F.greatest(F.col("_at"), F.col("_e")), F.col("_e"), attack, decay)
    found = near.groupBy(*times.columns).agg(F.max(level).alias("_level"))
    return times.join(found, list(times.columns), "left").withColumn(
        out, F.greatest(F.coalesce("_level", F.lit(0.0)), F.lit(0.0))).drop("_level")


def additive_hits(events: DataFrame, keys: Sequence[str], event_t: str, strength: str, frames: str, out: str = "level",
                  fps: float = 100.0, hold: float = 0.0, decay: float = 0.1) -> DataFrame:
    """Hits summed on a frame grid: flat for `hold`, then decaying until under 1e-3 of the strength.

    `frames` names a column with the series' length; only frames a hit reaches come back.
    """
    ring = math.floor((hold + decay * math.log(1e3)) * fps + 1e-9)
    first = F.floor(F.col(event_t) * fps + 0.5).cast("bigint")
    spread = events.withColumn("_i0", first).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(ring))))
    dt = F.col("_k") / F.lit(float(fps))
    level = F.when(dt < hold, 1.0).otherwise(F.exp(-(dt - hold) / decay))
    placed = spread.withColumn("frame", F.col("_i0") + F.col("_k")).withColumn("_e", level)
    return placed.where((F.col("frame") >= 0) & (F.col("frame") < F.col(frames)) & (F.col("_e") >= 1e-3)).groupBy(
        *keys, "frame").agg(F.sum(F.col(strength) * F.col("_e")).alias(out))


def count_between(windows: DataFrame, events: DataFrame, keys: Sequence[str], start: str, end: str, event_t: str,
                  out: str = "events", bucket: float = 3600.0) -> DataFrame:
    """Events in [start, end) of each window, as the difference of two ranks."""
    lo = rank_at(windows, events, keys, start, event_t, "_lo", inclusive=False, bucket=bucket)
    hi = rank_at(lo, events, keys, end, event_t, "_hi", inclusive=False, bucket=bucket)
    return hi.withColumn(out, F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0).cast("bigint"))).drop("_lo", "_hi")
