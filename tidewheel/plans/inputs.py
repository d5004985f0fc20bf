"""How the star-schema tables stand in for catalogues of series, notes, briefs and artifacts.

Every input has a Spark form and a SQL twin (a CTE) that the oracles build on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.series import frame_grid, level
from tidewheel.session import settle, table

SERIES = ["series_id"]
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def seconds(ts: str = "ts"):
    """Seconds since the event table's first midnight."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})") / 1e6


def days(ts: str = "l_shipdate"):
    return F.datediff(F.col(ts).cast("date"), F.lit("1995-01-01").cast("date"))


# ---- hourly levels per event type
def hourly(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return frame_grid(events, SERIES, seconds(), F.col("value"), 3600.0)


HOURLY = """
hourly AS (
  WITH b AS (SELECT event_type AS series_id, value AS v,
                    CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 / 3600.0 + 0.5) AS BIGINT) AS frame
             FROM events),
       e AS (SELECT series_id, max(frame) + 1 AS cnt FROM b GROUP BY 1),
       s AS (SELECT series_id, unnest(range(0, cnt)) AS frame FROM e)
  SELECT s.series_id, s.frame, count(b.v) AS n, coalesce(sum(b.v), 0.0) AS value, coalesce(sum(b.v * b.v), 0.0) AS square
  FROM s LEFT JOIN b USING (series_id, frame) GROUP BY 1, 2)"""


# ---- weekly sales per supplier: a catalogue that grows with the data
def weekly(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series_id"), "l_shipdate", "l_extendedprice")
    return frame_grid(lines, SERIES, days() / F.lit(7.0), F.col("l_extendedprice") / 71993.37, 1.0)


def weekly_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue's level table, settled: most operators read it more than once."""
    return settle(level(weekly(spark, sf)).select(
        "series_id", "frame", F.col("frame").cast("double").alias("t"), "value", "n", "rmsdb"))


WEEKLY = """
weekly AS (
  WITH b AS (SELECT l_suppkey AS series_id, l_extendedprice / 71993.37 AS v,
                    CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0 + 0.5) AS BIGINT) AS frame
             FROM lineitem),
       e AS (SELECT series_id, max(frame) + 1 AS cnt FROM b GROUP BY 1),
       s AS (SELECT series_id, unnest(range(0, cnt)) AS frame FROM e),
       g AS (SELECT s.series_id, s.frame, count(b.v) AS n, coalesce(sum(b.v), 0.0) AS value, coalesce(sum(b.v * b.v), 0.0) AS square
             FROM s LEFT JOIN b USING (series_id, frame) GROUP BY 1, 2)
  SELECT series_id, frame, CAST(frame AS DOUBLE) AS t, value, n,
         greatest(10 * log10(greatest(CASE WHEN n > 0 THEN square / n ELSE 0 END, 1e-30)), -100.0) AS rmsdb
  FROM g)"""


def weekly_flux(spark: SparkSession, sf: str) -> DataFrame:
    from tidewheel.operators.series import rising

    return rising(weekly_levels(spark, sf), SERIES, "value", "flux")


WEEKLY_FLUX = WEEKLY + """,
weekly_flux AS (
  SELECT *, greatest(value - coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY frame), value), 0.0) AS flux FROM weekly)"""


# ---- two versions of each supplier's series: all lines, and a delayed one without returns
def versions(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, frame, old, new) in dB; the new version lags series_id % 4 weeks and lacks one flag."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), "l_shipdate", "l_extendedprice", "l_returnflag")
    t, v = days() / F.lit(7.0), F.col("l_extendedprice") / 71993.37
    old = level(frame_grid(lines, SERIES, t, v, 1.0)).select("series_id", "frame", F.col("rmsdb").alias("value"))
    later = t + F.col("series_id") % 4
    new = level(frame_grid(lines.where(F.col("l_returnflag") != "R"), SERIES, later, v, 1.0)).select(
        "series_id", "frame", F.col("rmsdb").alias("value"))
    from tidewheel.operators.align import pair_up

    return settle(pair_up(old, new, SERIES))


def _version_sql(name: str, shift: str, where: str) -> str:
    return f"""
{name} AS (
  WITH b AS (SELECT l_suppkey AS series_id, l_extendedprice / 71993.37 AS v,
                    CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0 + {shift} + 0.5) AS BIGINT) AS frame
             FROM lineitem WHERE {where}),
       e AS (SELECT series_id, max(frame) + 1 AS cnt FROM b GROUP BY 1),
       s AS (SELECT series_id, unnest(range(0, cnt)) AS frame FROM e),
       g AS (SELECT s.series_id, s.frame, count(b.v) AS n, coalesce(sum(b.v * b.v), 0.0) AS square
             FROM s LEFT JOIN b USING (series_id, frame) GROUP BY 1, 2)
  SELECT series_id, frame, greatest(10 * log10(greatest(CASE WHEN n > 0 THEN square / n ELSE 0 END, 1e-30)), -100.0) AS value FROM g)"""


VERSIONS = (_version_sql("old_v", "0", "TRUE") + "," + _version_sql("new_v", "(l_suppkey % 4)", "l_returnflag <> 'R'") + """,
versions AS (
  SELECT coalesce(o.series_id, n.series_id) AS series_id, coalesce(o.frame, n.frame) AS frame, o.value AS old, n.value AS new
  FROM old_v o FULL JOIN new_v n ON o.series_id = n.series_id AND o.frame = n.frame),
vsize AS (SELECT series_id, count(old) AS na, count(new) AS nb FROM versions GROUP BY 1)""")
