"""Queries over events, lookups, scalar functions and edit plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import scalar as S
from tidewheel.operators import edit as X
from tidewheel.operators import events as E
from tidewheel.operators import joins as J
from tidewheel.operators import series as O
from tidewheel.operators.grid import beat_rows as grid_beats
from tidewheel.plans.inputs import SERIES, WEEKLY, seconds, weekly, weekly_levels
from tidewheel.plans.series_queries import fixed_sections
from tidewheel.session import settle, table

QUERIES, ORACLES = {}, {}
USER = ["user_id"]


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def timed(spark, sf, kind=None):
    ev = table(spark, sf, "events")
    if kind is not None:
        ev = ev.where(F.col("event_type") == kind)
    return ev.select("user_id", "event_id", seconds().alias("t"), "value")


TIMED = "ev AS (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t FROM events), vw AS (SELECT * FROM ev WHERE event_type = 'view'), er AS (SELECT * FROM ev WHERE event_type = 'error')"
DAY = 86400.0


# ---- lookups
@query("asof_last_event", f"""WITH {TIMED} SELECT ev.user_id, ev.event_id, vw.event_id AS last_id, round(greatest(ev.t - vw.t, 0.0), 6) AS since
FROM ev ASOF LEFT JOIN vw ON ev.user_id = vw.user_id AND ev.t + 1e-6 >= vw.t""")
def asof_last_event(spark, sf):
    views = timed(spark, sf, "view").withColumnRenamed("event_id", "last_id")
    return E.since_last(timed(spark, sf), views, USER, "t", "t", ["last_id"], bucket=DAY).select(
        "user_id", "event_id", "last_id", *r6("since"))


@query("nearest_event", f"""WITH {TIMED}, b AS (SELECT ev.user_id, ev.event_id, ev.t, vw.t AS b FROM ev ASOF LEFT JOIN vw ON ev.user_id = vw.user_id AND ev.t >= vw.t),
a AS (SELECT ev.event_id, vw.t AS a FROM ev ASOF LEFT JOIN vw ON ev.user_id = vw.user_id AND ev.t <= vw.t)
SELECT user_id, event_id, round(CASE WHEN b IS NULL OR a - t < t - b THEN a ELSE b END, 6) AS nearest_t, round(abs(t - CASE WHEN b IS NULL OR a - t < t - b THEN a ELSE b END), 6) AS gap FROM b JOIN a USING (event_id)""")
def nearest_event(spark, sf):
    return J.nearest_join(timed(spark, sf), timed(spark, sf, "view"), USER, "t", "t", bucket=DAY).select(
        "user_id", "event_id", *r6("nearest_t", "gap"))


@query("event_count_interval", f"""WITH {TIMED} SELECT ev.user_id, ev.event_id, count(vw.event_id) AS events FROM ev LEFT JOIN vw ON ev.user_id = vw.user_id AND vw.t >= ev.t - 1e-6 AND vw.t < ev.t + 172800.0 - 1e-6 GROUP BY 1, 2""")
def event_count_interval(spark, sf):
    windows = timed(spark, sf).withColumn("until", F.col("t") + 172800.0)
    return E.count_between(windows, timed(spark, sf, "view"), USER, "t", "until", "t", bucket=DAY).select(
        "user_id", "event_id", "events")


@query("event_rank", f"""WITH {TIMED} SELECT ev.user_id, ev.event_id, count(vw.event_id) AS nth FROM ev LEFT JOIN vw ON ev.user_id = vw.user_id AND vw.t <= ev.t + 1e-6 GROUP BY 1, 2""")
def event_rank(spark, sf):
    return J.rank_at(timed(spark, sf), timed(spark, sf, "view"), USER, "t", "t", "nth", bucket=DAY).select(
        "user_id", "event_id", "nth")


@query("pulse", f"""WITH {TIMED} SELECT ev.user_id, ev.event_id, round(coalesce(exp(-greatest(ev.t - vw.t, 0.0) / 36000.0), 0.0), 6) AS pulse
FROM ev ASOF LEFT JOIN vw ON ev.user_id = vw.user_id AND ev.t + 3600 >= vw.t""")
def pulse(spark, sf):
    return E.pulse(timed(spark, sf), timed(spark, sf, "view"), USER, "t", "t", tau=36000.0, lead=3600.0, bucket=DAY).select(
        "user_id", "event_id", *r6("pulse"))


@query("event_envelope", f"""WITH {TIMED}, x AS (SELECT ev.user_id, ev.event_id, vw.value / 500.0 * CASE WHEN greatest(ev.t, vw.t) - vw.t < 600 THEN (greatest(ev.t, vw.t) - vw.t) / 600.0 ELSE exp(-(greatest(ev.t, vw.t) - vw.t - 600) / 7200.0) END AS v
 FROM ev JOIN vw ON ev.user_id = vw.user_id AND ev.t >= vw.t - 1e-6 AND ev.t <= vw.t + 72600.0)
SELECT ev.user_id, ev.event_id, round(coalesce(max(v), 0.0), 6) AS level FROM ev LEFT JOIN x USING (user_id, event_id) GROUP BY 1, 2""")
def event_envelope(spark, sf):
    hits = timed(spark, sf, "view").withColumn("strength", F.col("value") / 500.0)
    return E.event_envelope(timed(spark, sf).select("user_id", "event_id", "t"), hits, USER, "t", "t", "strength",
                            attack=600.0, decay=7200.0).select("user_id", "event_id", *r6("level"))


@query("additive_hits", f"""WITH {TIMED}, h AS (SELECT user_id, CAST(floor(t / 3600 + 0.5) AS BIGINT) AS i0, value / 711.3 AS s FROM er), k AS (SELECT user_id, i0 + k AS frame, s * CASE WHEN k < 2 THEN 1.0 ELSE exp(-(k - 2) / 3.0) END AS v, CASE WHEN k < 2 THEN 1.0 ELSE exp(-(k - 2) / 3.0) END AS e FROM h, range(0, 30) r(k))
SELECT user_id, frame, round(sum(v), 6) AS level FROM k WHERE e >= 1e-3 AND frame >= 0 GROUP BY 1, 2""")
def additive_hits(spark, sf):
    hits = timed(spark, sf, "error").select("user_id", (F.col("t") / 3600).alias("t"), (F.col("value") / 711.3).alias("s"))
    # Each user's series lasts until its last hit has rung out: 2 frames held, then 3 ln 1000 more.
    ends = hits.groupBy("user_id").agg((F.floor(F.max("t") + 0.5) + 24).cast("int").alias("frames"))
    hits = hits.join(ends, "user_id")
    return E.additive_hits(hits, USER, "t", "s", "frames", fps=1.0, hold=2.0, decay=3.0).select("user_id", "frame", *r6("level"))


@query("keyframe_schedule", f"""WITH {TIMED}, k0 AS (SELECT ev.user_id, ev.event_id, ev.t, vw.t AS t0, vw.value AS v0 FROM ev ASOF LEFT JOIN vw ON ev.user_id = vw.user_id AND ev.t >= vw.t),
k1 AS (SELECT ev.event_id, vw.t AS t1, vw.value AS v1 FROM ev ASOF LEFT JOIN vw ON ev.user_id = vw.user_id AND ev.t < vw.t),
u AS (SELECT *, least(greatest((t - t0) / (t1 - t0), 0.0), 1.0) AS u FROM k0 JOIN k1 USING (event_id))
SELECT user_id, event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * u * u * (3 - 2 * u) END, 6) AS level FROM u""")
def keyframe_schedule(spark, sf):
    return J.keyframe_values(timed(spark, sf).select("user_id", "event_id", "t"), timed(spark, sf, "view"), USER, "t", "t", "value",
                             "level", bucket=DAY).select("user_id", "event_id", *r6("level"))


SAMPLES = "smp AS (SELECT l_suppkey AS series_id, l_orderkey, l_linenumber, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0 - 3.0 AS pos FROM lineitem)"


def sample_points(spark, sf):
    from tidewheel.plans.inputs import days

    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series_id"), "l_orderkey", "l_linenumber",
                                               (days() / 7.0 - 3.0).alias("pos"))


@query("sample_linear", f"""WITH {WEEKLY}, {SAMPLES}, z AS (SELECT series_id, max(frame) AS m FROM weekly GROUP BY 1),
c AS (SELECT s.*, least(greatest(pos, 0.0), m) AS p FROM smp s JOIN z USING (series_id))
SELECT c.series_id, l_orderkey, l_linenumber, round(a.value + (coalesce(b.value, a.value) - a.value) * (p - floor(p)), 6) AS level
FROM c JOIN weekly a ON a.series_id = c.series_id AND a.frame = CAST(floor(p) AS BIGINT) LEFT JOIN weekly b ON b.series_id = c.series_id AND b.frame = CAST(floor(p) AS BIGINT) + 1""")
def sample_linear(spark, sf):
    return J.sample_linear(sample_points(spark, sf), weekly_levels(spark, sf), SERIES, "pos", "value", "level").select(
        "series_id", "l_orderkey", "l_linenumber", *r6("level"))


@query("held_levels", f"""WITH {WEEKLY}, {SAMPLES}, z AS (SELECT series_id, max(frame) AS m FROM weekly GROUP BY 1),
c AS (SELECT s.*, least(greatest(floor(pos * 0.25 + 1e-6) / 0.25, 0.0), m) AS p FROM smp s JOIN z USING (series_id))
SELECT c.series_id, l_orderkey, l_linenumber, round(a.value, 6) AS level FROM c JOIN weekly a ON a.series_id = c.series_id AND a.frame = CAST(p AS BIGINT)""")
def held_levels(spark, sf):
    return O.held_levels(sample_points(spark, sf), weekly_levels(spark, sf), SERIES, "pos", "value", "level", fps=1.0, rate=0.25).select(
        "series_id", "l_orderkey", "l_linenumber", *r6("level"))


@query("box_mean", f"""WITH {WEEKLY}, s AS (SELECT series_id, frame, k, frame + 0.5 - 2.0 + k * 0.5 AS pos FROM weekly, range(0, 9) r(k) WHERE n > 0), z AS (SELECT series_id, max(frame) AS m FROM weekly GROUP BY 1),
c AS (SELECT s.*, least(greatest(pos, 0.0), m) AS p FROM s JOIN z USING (series_id))
SELECT c.series_id, c.frame, round(avg(a.value + (coalesce(b.value, a.value) - a.value) * (p - floor(p))), 6) AS level
FROM c JOIN weekly a ON a.series_id = c.series_id AND a.frame = CAST(floor(p) AS BIGINT) LEFT JOIN weekly b ON b.series_id = c.series_id AND b.frame = CAST(floor(p) AS BIGINT) + 1 GROUP BY 1, 2""")
def box_mean(spark, sf):
    levels = weekly_levels(spark, sf)
    points = levels.where("n > 0").select("series_id", "frame", (F.col("frame") + 0.5).alias("pos"))
    return O.box_mean(points, levels, SERIES, "pos", "value", "level", 2.0, 1.0, step=0.5).select("series_id", "frame", *r6("level"))


@query("near_event_max", f"""WITH {WEEKLY}, {SAMPLES}, z AS (SELECT series_id, max(frame) AS m FROM weekly GROUP BY 1), x AS (SELECT series_id, frame, max(value) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS level FROM weekly)
SELECT s.series_id, l_orderkey, l_linenumber, round(level, 6) AS level FROM smp s JOIN z USING (series_id) JOIN x ON x.series_id = s.series_id AND x.frame = least(greatest(CAST(round_even(pos, 0) AS BIGINT), 0), m)""")
def near_event_max(spark, sf):
    return O.near_event_max(weekly_levels(spark, sf), sample_points(spark, sf), SERIES, "value", "pos", "level", fps=1.0).select(
        "series_id", "l_orderkey", "l_linenumber", *r6("level"))


@query("interval_containment", f"""WITH {WEEKLY} SELECT series_id, CAST(frame // 60 AS BIGINT) AS section, count(*) AS beats, round(sum(value), 6) AS total FROM weekly WHERE n >= 2 AND frame < 420 GROUP BY 1, 2""")
def interval_containment(spark, sf):
    beats = weekly_levels(spark, sf).where("n >= 2")
    return J.interval_join(beats, fixed_sections(spark, sf), SERIES, "t", "start", "end", 60.0).groupBy("series_id", "section").agg(
        F.count("*").alias("beats"), F.round(F.sum("value"), 6).alias("total"))


@query("interval_semi", f"""WITH {TIMED} SELECT user_id, event_id FROM ev WHERE EXISTS (SELECT 1 FROM vw WHERE vw.user_id = ev.user_id AND ev.t >= vw.t + 60 AND ev.t < vw.t + 7260)""")
def interval_semi(spark, sf):
    spans = timed(spark, sf, "view").select("user_id", (F.col("t") + 60.0).alias("start"), (F.col("t") + 7260.0).alias("end"))
    return J.interval_join(timed(spark, sf), spans, USER, "t", "start", "end", 7200.0, how="left_semi").select("user_id", "event_id")


@query("change_rows", f"""WITH {WEEKLY}, x AS (SELECT *, CASE WHEN n >= 2 THEN 'busy' ELSE 'calm' END AS s FROM weekly), y AS (SELECT *, lag(s) OVER (PARTITION BY series_id ORDER BY frame) AS p FROM x)
SELECT series_id, frame, s AS state FROM y WHERE p IS NULL OR p <> s""")
def change_rows(spark, sf):
    states = weekly_levels(spark, sf).withColumn("state", F.when(F.col("n") >= 2, "busy").otherwise("calm"))
    return J.changes(states, SERIES, "frame", ["state"]).select("series_id", "frame", "state")


@query("unknown_names", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def unknown_names(spark, sf):
    known = table(spark, sf, "customer").where(F.col("c_mktsegment") != "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(known, "o_custkey", "left_anti").select("o_custkey", "o_orderkey")


@query("shared_scan", "SELECT l_orderkey, l_linenumber, round(sin(p_size) * cos(p_retailprice), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey")
def shared_scan(spark, sf):
    """Each distinct part is scored once, however many lines use it."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    scored = table(spark, sf, "part").dropDuplicates(["p_partkey"]).select(
        "p_partkey", F.round(F.sin("p_size") * F.cos("p_retailprice"), 6).alias("score"))
    return lines.join(scored, "p_partkey").select("l_orderkey", "l_linenumber", "score")


# ---- assignment
_LOOKS = """looks AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS ord, avg(p_size * 3.6) AS hue, avg(p_size) / 50 AS sat, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END AS temp FROM part GROUP BY 1),
parts AS (SELECT p_partkey, p_size * 3.6 AS hue, (p_retailprice - 900) / 100 AS sat, (p_partkey % 97) / 97.0 AS bright FROM part)"""


@query("best_match", f"""WITH {_LOOKS}, s AS (SELECT p_partkey, name, ord, round(0.5 * (1 - least(abs(p.hue - l.hue), 180 - abs(p.hue - l.hue)) / 90.0) + 0.3 * (1 - abs(p.sat - least(greatest(0.5 + l.sat / 4, 0), 1))) + 0.2 * (1 - abs(bright - CASE WHEN temp < 0 THEN 0.35 ELSE 0.55 END)), 9) AS score FROM parts p, looks l)
SELECT p_partkey, name AS best, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, ord) = 1""")
def best_match(spark, sf):
    part = table(spark, sf, "part")
    looks = part.groupBy(F.col("p_brand").alias("name")).agg(F.avg(F.col("p_size") * 3.6).alias("look_hue"), (F.avg("p_size") / 50).alias("look_sat"))
    looks = looks.withColumn("temp", F.when(F.substring("name", 7, 9).cast("int") % 2 == 0, 1.0).otherwise(-1.0)).withColumn("brief", F.lit(1))
    # Brands in name order, as the brief lists them.
    listed = looks.groupBy("brief").agg(F.array_sort(F.collect_list("name")).alias("_names"))
    looks = looks.join(listed, "brief").withColumn("ord", F.array_position("_names", F.col("name"))).drop("_names")
    assets = part.select("p_partkey", (F.col("p_size") * 3.6).alias("hue"), ((F.col("p_retailprice") - 900) / 100).alias("sat"),
                         ((F.col("p_partkey") % 97) / 97.0).alias("bright"), F.lit(1).alias("brief"))

    def score(p):
        return F.round(S.look_score(F.col("hue"), F.col("sat"), F.col("bright"), p["look_hue"], p["look_sat"], p["temp"]), 9)

    return J.best_match(assets, looks, ["brief"], score, "name", "ord").select("p_partkey", "best", *r6("score"))


@query("round_robin", """WITH pool AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_partkey * 7919 % 10007) / 10007.0, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')),
slots AS (SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem)
SELECT s.l_suppkey, s.l_orderkey, s.l_linenumber, p.l_partkey AS source FROM slots s JOIN pool p ON p.l_suppkey = s.l_suppkey AND p.k = (s.l_orderkey * 7 + s.l_linenumber) % p.n""")
def round_robin(spark, sf):
    lines = table(spark, sf, "lineitem")
    slots = lines.select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("slot"))
    pool = lines.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey").distinct()
    shuffle = (F.col("l_partkey") * 7919 % 10007) / 10007.0
    return J.round_robin(slots, pool, ["l_suppkey"], "slot", "l_partkey", "source", shuffle=shuffle).select(
        "l_suppkey", "l_orderkey", "l_linenumber", "source")


# ---- edit plans
FPS = 24
_SONGS = """sections AS (SELECT series_id, k AS section, k * 22.2 AS s, (k + 1) * 22.2 AS e, ['every_2_beats', 'every_beat', 'static', 'every_bar'][1 + (k + series_id) % 4] AS density FROM (SELECT series_id, unnest(range(0, CAST(floor(max(frame) * 0.37 / 22.2) AS BIGINT) + 1)) AS k FROM weekly GROUP BY series_id)),
beats AS (SELECT series_id, frame * 0.37 AS t FROM weekly WHERE n >= 2)"""
_CUTS = """pts AS (SELECT DISTINCT series_id, section, t, e, dv FROM (
   SELECT x.series_id, x.section, b.t, x.e, dv FROM sx x JOIN beats b ON b.series_id = x.series_id AND b.t >= x.s AND b.t <= x.e WHERE dv > 0
   UNION ALL SELECT series_id, section, s, e, dv FROM sx WHERE dv > 0 UNION ALL SELECT series_id, section, e, e, dv FROM sx WHERE dv > 0)),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, section ORDER BY t) - 1 AS n FROM pts),
sn AS (SELECT DISTINCT series_id, section, round_even(t * 24, 0) / 24 AS t FROM (SELECT series_id, section, t FROM rk WHERE n % dv = 0 OR t = e UNION ALL SELECT series_id, section, s FROM sx WHERE dv = 0 UNION ALL SELECT series_id, section, e FROM sx WHERE dv = 0)),
cuts AS (SELECT * FROM (SELECT series_id, section, lag(t) OVER (PARTITION BY series_id, section ORDER BY t) AS s, t AS e FROM sn) WHERE s IS NOT NULL)"""
CUTS = WEEKLY + "," + _SONGS + ", sx AS (SELECT *, CASE density WHEN 'every_beat' THEN 1 WHEN 'every_2_beats' THEN 2 WHEN 'every_bar' THEN 4 ELSE 0 END AS dv FROM sections)," + _CUTS


def songs(spark, sf):
    levels = weekly_levels(spark, sf)
    ids = levels.groupBy("series_id").agg(F.floor(F.max("frame") * 0.37 / 22.2).cast("bigint").alias("last"))
    density = F.element_at(F.array(*[F.lit(d) for d in ("every_2_beats", "every_beat", "static", "every_bar")]),
                           (1 + (F.col("section") + F.col("series_id")) % 4).cast("int"))
    sections = ids.withColumn("section", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).select(
        "series_id", "section", (F.col("section") * 22.2).alias("start"), ((F.col("section") + 1) * 22.2).alias("end"),
        density.alias("cut_density"), F.lit(120.0).alias("bpm"),
        F.array(*[F.lit(e) for e in ("grain", "kaleidoscope", "freeze_on_peak", "strobe")]).alias("effects"),
        F.concat(F.lit("Brand#"), (F.col("series_id") % 25 + 1).cast("string")).alias("station"))
    beats = levels.where("n >= 2").select("series_id", (F.col("frame") * 0.37).alias("t"))
    jumps = levels.where("n >= 6").select("series_id", (F.col("frame") * 0.37).alias("t"))
    onsets = levels.where("n = 5").select("series_id", (F.col("frame") * 0.37).alias("t"))
    return settle(sections), beats, jumps, onsets


@query("cut_boundaries", f'WITH {CUTS} SELECT series_id, section, round(s, 6) AS start, round(e, 6) AS "end" FROM cuts')
def cut_boundaries(spark, sf):
    sections, beats, _, _ = songs(spark, sf)
    return X.cut_boundaries(sections, beats, SERIES, FPS).select("series_id", "section", *r6("start", "end"))


@query("cut_plan", f"""WITH {CUTS},
ix AS (SELECT *, row_number() OVER (PARTITION BY series_id, section ORDER BY s) - 1 AS k, row_number() OVER (PARTITION BY series_id ORDER BY s, e) - 1 AS idx FROM cuts),
jm AS (SELECT series_id, frame * 0.37 AS t FROM weekly WHERE n >= 6), oz AS (SELECT series_id, frame * 0.37 AS t FROM weekly WHERE n = 5),
pool AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 7919 % 10007) / 10007.0, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT i.series_id, i.section, i.idx, round(i.s, 6) AS start, round(i.e, 6) AS "end", p_partkey AS source_path,
  'grain' || CASE WHEN k > 0 AND k % 7 = 0 THEN ',kaleidoscope' ELSE '' END || CASE WHEN EXISTS (SELECT 1 FROM jm WHERE jm.series_id = i.series_id AND jm.t >= i.s AND jm.t < i.e) THEN ',freeze_on_peak' ELSE '' END
   || CASE WHEN EXISTS (SELECT 1 FROM oz WHERE oz.series_id = i.series_id AND oz.t >= i.s AND oz.t < i.e) THEN ',strobe' ELSE '' END AS effects, density <> 'static' AS is_beat_aligned
FROM ix i JOIN sections x ON x.series_id = i.series_id AND x.section = i.section JOIN pool p ON p.p_brand = 'Brand#' || (i.series_id % 25 + 1) AND p.r = i.k % p.n""")
def cut_plan(spark, sf):
    sections, beats, jumps, onsets = songs(spark, sf)
    assets = table(spark, sf, "part").select(F.col("p_brand").alias("station"), F.col("p_partkey").alias("path"))
    shuffle = (F.col("path") * 7919 % 10007) / 10007.0
    return X.compose(sections, beats, assets, jumps, onsets, SERIES, FPS, shuffle=shuffle).select(
        "series_id", "section", "idx", *r6("start", "end"), "source_path", F.array_join("effects", ",").alias("effects"), "is_beat_aligned")


@query("clip_window", f"""WITH {CUTS}, w AS (SELECT series_id, greatest(s, round_even(30.01 * 24, 0) / 24) - round_even(30.01 * 24, 0) / 24 AS s, least(e, round_even(90.03 * 24, 0) / 24) - round_even(30.01 * 24, 0) / 24 AS e FROM cuts)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY s, e) - 1 AS idx, round(s, 6) AS start, round(e, 6) AS "end" FROM w WHERE e - s >= 1.0 / 24 - 1e-9""")
def clip_window(spark, sf):
    sections, beats, _, _ = songs(spark, sf)
    cuts = settle(X.cut_boundaries(sections, beats, SERIES, FPS))
    return J.clip_intervals(cuts, SERIES, "start", "end", F.lit(30.01), F.lit(90.03), FPS).select("series_id", "idx", *r6("start", "end"))


_PROPOSE = WEEKLY + """,
f AS (SELECT *, rmsdb < -5.0 AS q, lead(t) OVER (PARTITION BY series_id ORDER BY frame) AS nt, row_number() OVER (PARTITION BY series_id ORDER BY frame) AS rn FROM weekly),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY series_id, q ORDER BY frame) AS isl FROM f),
qp AS (SELECT series_id, min(t) AS s, max(coalesce(nt, t)) AS e FROM g WHERE q GROUP BY series_id, isl HAVING max(coalesce(nt, t)) - min(t) >= 4),
sg AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS dur FROM weekly GROUP BY 1),
cand AS (SELECT DISTINCT series_id, round(t, 2) AS t FROM (SELECT series_id, s AS t FROM qp UNION ALL SELECT series_id, e FROM qp UNION ALL SELECT series_id, t FROM weekly WHERE n >= 9 UNION ALL SELECT series_id, 0.0 FROM sg UNION ALL SELECT series_id, dur FROM sg)),
chain AS (SELECT series_id, CAST(0 AS DOUBLE) AS t, 0 AS k, dur FROM sg UNION ALL
  SELECT c.series_id, (SELECT min(d.t) FROM cand d WHERE d.series_id = c.series_id AND d.t - c.t >= greatest(4.0, c.dur * 0.05)) AS t, k + 1, dur FROM chain c
  WHERE EXISTS (SELECT 1 FROM cand d WHERE d.series_id = c.series_id AND d.t - c.t >= greatest(4.0, c.dur * 0.05))),
kept AS (SELECT series_id, k, CASE WHEN k = max(k) OVER (PARTITION BY series_id) THEN dur ELSE t END AS t, max(k) OVER (PARTITION BY series_id) AS n, dur FROM chain),
bnd AS (SELECT series_id, k, t FROM kept WHERE n BETWEEN 3 AND 6 UNION ALL SELECT DISTINCT series_id, r.k, round(dur * r.k / CASE WHEN n < 3 THEN 3 ELSE 6 END, 2) FROM kept, range(0, 7) r(k) WHERE n NOT BETWEEN 3 AND 6 AND r.k <= CASE WHEN n < 3 THEN 3 ELSE 6 END)"""


@query("propose_sections", f'WITH RECURSIVE {_PROPOSE.strip()} SELECT * FROM (SELECT series_id, CAST(k AS INTEGER) AS section, t AS start, lead(t) OVER (PARTITION BY series_id ORDER BY k) AS "end" FROM bnd) WHERE "end" IS NOT NULL')
def propose_sections(spark, sf):
    levels = weekly_levels(spark, sf)
    quiet = O.quiet_passages(levels, SERIES, "rmsdb", threshold=-5.0, min_duration=4.0)
    span = levels.groupBy("series_id").agg((F.count("*") + 0.0).alias("duration"))
    jumps = levels.where("n >= 9").select("series_id", "t")
    return X.sections_of(X.propose_sections(span, quiet, jumps, SERIES), SERIES).select("series_id", "section", "start", "end")


@query("auto_style", f"""WITH {WEEKLY}, m AS (SELECT series_id, frame // 60 AS section, avg(value) AS v FROM weekly GROUP BY 1, 2)
SELECT series_id, CAST(section AS BIGINT) AS section, CASE WHEN round(v, 9) < 0.6 THEN 'every_2_beats' ELSE 'every_beat' END AS cut_density, CASE WHEN round(v, 9) < 0.6 THEN 'grain,vignette' ELSE 'grain,strobe,vignette' END AS effects FROM m""")
def auto_style(spark, sf):
    loud = weekly(spark, sf).groupBy("series_id", F.floor(F.col("frame") / 60).cast("bigint").alias("section")).agg(
        F.round(F.avg("value"), 9).alias("loudness"))
    return X.auto_style(loud, "loudness").select("series_id", "section", "cut_density", F.array_join("effects", ",").alias("effects"))


@query("highlight", f"""WITH {WEEKLY}, s AS (SELECT series_id, count(*) + 0.0 AS dur FROM weekly GROUP BY 1)
SELECT series_id, t AS highlight_t FROM weekly JOIN s USING (series_id) WHERE dur >= 45 AND t >= 15 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(value, 9) DESC, t) = 1""")
def highlight(spark, sf):
    levels = weekly_levels(spark, sf)
    span = levels.groupBy("series_id").agg((F.count("*") + 0.0).alias("duration"))
    return X.highlight(levels, SERIES, "t", "value", span)


@query("chapters", """WITH c AS (SELECT conv_id, turn, role, 37.0 * turn * (1 + conv_id % 9) * 20 AS s FROM conversations), m AS (SELECT conv_id, min(s) AS f FROM c GROUP BY 1)
SELECT conv_id, s AS t, CASE WHEN s >= 3600 THEN CAST(floor(s / 3600) AS BIGINT) || ':' || lpad(CAST(CAST(floor(s / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(s AS BIGINT) % 60 AS VARCHAR), 2, '0')
   ELSE CAST(floor(s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(s AS BIGINT) % 60 AS VARCHAR), 2, '0') END || ' ' || role AS text FROM c JOIN m USING (conv_id) WHERE s > f""")
def chapters(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "role", (37.0 * F.col("turn") * (1 + F.col("conv_id") % 9) * 20).alias("start"))
    return X.chapters(turns, ["conv_id"], "start", "role", skip_first=True)


@query("teaser_and_thumbs", """SELECT o_orderkey, k AS n, round(o_totalprice / 1013.7 * k / 4.0, 6) AS t, round(CASE WHEN o_orderstatus = 'P' THEN 3.0 ELSE greatest(0.0, o_totalprice / 1013.7 / 2 - 15.0 / 2) END, 6) AS teaser FROM orders, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k)""")
def teaser_and_thumbs(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1013.7).alias("duration"))
    thumbs = X.thumbnail_times(o, ["o_orderkey", "o_orderstatus"], "duration", 3)
    given = F.when(F.col("o_orderstatus") == "P", 3.0)
    return thumbs.join(o.select("o_orderkey", "duration"), "o_orderkey").select(
        "o_orderkey", "n", F.round("t", 6).alias("t"), F.round(X.teaser_start(F.col("duration"), F.lit(15.0), given), 6).alias("teaser"))


@query("expand_outputs", """WITH c AS (SELECT o_orderkey, 'cut' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['reel', 'short'][1:1 + o_orderkey % 2] END AS p, CASE WHEN o_orderkey % 2 = 0 THEN ['lamp', 'door'] ELSE [] END AS e FROM orders),
x AS (SELECT o_orderkey, name, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS platform, e FROM c), y AS (SELECT o_orderkey, name, platform, unnest(CASE WHEN len(e) = 0 THEN [NULL] ELSE e END) AS ending FROM x)
SELECT *, concat_ws('.', 'song', name, platform, ending) || '.mp4' AS out FROM y""")
def expand_outputs(spark, sf):
    none = F.array().cast("array<string>")
    k = F.col("o_orderkey")
    cuts = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("cut"), k).alias("name"), F.lit("song").alias("title"),
        F.when(k % 3 == 0, none).otherwise(F.slice(F.array(F.lit("reel"), F.lit("short")), 1, (1 + k % 2).cast("int"))).alias("p"),
        F.when(k % 2 == 0, F.array(F.lit("lamp"), F.lit("door"))).otherwise(none).alias("e"))
    return X.expand_outputs(cuts, ["o_orderkey"], "name", "p", "e", "title")


@query("sheet_picks", """WITH o AS (SELECT o_orderkey, 10 + o_orderkey % 90 AS body, 11 + o_orderkey % 90 + o_custkey % 50 AS total FROM orders), s AS (SELECT *, total - body AS span, greatest(1, least(5, total - body)) AS n FROM o)
SELECT o_orderkey, 0 AS place, body - 1 AS frame FROM s UNION ALL SELECT o_orderkey, CAST(k + 1 AS INTEGER), CASE WHEN n = 1 THEN body ELSE body + (2 * k * (span - 1) + n - 1) // (2 * (n - 1)) END FROM s, range(0, 5) r(k) WHERE k < n""")
def sheet_picks(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", (10 + k % 90).alias("body"), (11 + k % 90 + F.col("o_custkey") % 50).alias("total"))
    return X.sheet_picks(o, ["o_orderkey"], "body", "total", 5)


@query("plan_covers", """WITH w AS (SELECT DISTINCT l_orderkey, CASE l_linenumber % 5 WHEN 0 THEN 'instagram-reel-cover' WHEN 1 THEN 'instagram-grid-thumbnail' WHEN 2 THEN 'square' WHEN 3 THEN 'banner' ELSE 'wide' END AS platform FROM lineitem),
d AS (SELECT l_orderkey, platform FROM w UNION ALL SELECT l_orderkey, 'instagram-grid-thumbnail' FROM w WHERE platform = 'instagram-reel-cover' AND l_orderkey NOT IN (SELECT l_orderkey FROM w WHERE platform = 'instagram-grid-thumbnail')),
s AS (SELECT *, l_orderkey % 2 = 0 AS portrait FROM d)
SELECT l_orderkey, platform, CASE platform WHEN 'instagram-grid-thumbnail' THEN 'instagram-reel-cover' WHEN 'instagram-reel-cover' THEN CASE WHEN portrait THEN 'portrait' ELSE 'master' END ELSE 'master' END AS source,
 CASE platform WHEN 'instagram-grid-thumbnail' THEN 'grid crop' WHEN 'square' THEN 'scale' WHEN 'banner' THEN 'centre band' WHEN 'instagram-reel-cover' THEN CASE WHEN portrait THEN 'scale' ELSE 'pad-blur' END ELSE 'pad-blur' END AS method FROM s""")
def plan_covers(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("instagram-reel-cover", "instagram-grid-thumbnail", "square", "banner", "wide")]),
                        (F.col("l_linenumber") % 5 + 1).cast("int"))
    size = F.create_map(*[x for n, w, h in (("instagram-reel-cover", 1080, 1920), ("instagram-grid-thumbnail", 1080, 1440), ("square", 3000, 3000),
                                            ("banner", 2480, 520), ("wide", 1280, 720)) for x in (F.lit(n), F.array(F.lit(w), F.lit(h)))])
    wanted = table(spark, sf, "lineitem").select("l_orderkey", kind.alias("platform")).distinct()
    wanted = wanted.withColumn("w", size[F.col("platform")][0]).withColumn("h", size[F.col("platform")][1]).withColumn(
        "portrait", F.col("l_orderkey") % 2 == 0)
    return X.plan_covers(wanted, ["l_orderkey"], "platform", "w", "h", "portrait")


@query("beat_rows", f"""WITH {WEEKLY}, g AS (SELECT series_id, (series_id % 10) * 0.1 AS b0, 60.0 / (80 + series_id % 60) AS p, count(*) * 0.37 AS dur FROM weekly GROUP BY 1)
SELECT series_id, k AS idx, round(b0 + k * p, 6) AS t FROM (SELECT *, unnest(range(0, CAST(ceil((dur - b0) / p) AS BIGINT))) AS k FROM g)""")
def beat_rows(spark, sf):
    grids = weekly(spark, sf).groupBy("series_id").agg((F.count("*") * 0.37).alias("dur"))
    return grid_beats(grids, SERIES, (F.col("series_id") % 10) * 0.1, 60.0 / (80 + F.col("series_id") % 60), F.col("dur")).select(
        "series_id", "idx", *r6("t"))


# ---- scalar functions
@query("scalar_levels", """SELECT l_orderkey, l_linenumber, round(greatest(10 * log10(greatest(l_tax * l_tax, 1e-30)), -100.0), 6) AS db,
 round(round_even(l_quantity * 0.37 * 24, 0) / 24, 6) AS snapped, round(floor(round_even(l_quantity * 0.37 * 24, 0) / 24 * 1e6 + 1e-3) / 1e6, 6) AS clock,
 CAST(ceil(l_quantity * 0.37 * 24 - 1e-6) AS BIGINT) AS first_frame,
 CASE WHEN floor(l_quantity * 0.25 * 24 + 0.5) >= 0 AND floor(l_quantity * 0.25 * 24 + 0.5) < 250 AND abs(l_quantity * 0.25 * 24 - floor(l_quantity * 0.25 * 24 + 0.5)) <= 0.01 THEN CAST(floor(l_quantity * 0.25 * 24 + 0.5) AS BIGINT) END AS on_grid,
 round(floor(l_quantity * 0.37 * 12 + 1e-6) / 12, 6) AS held FROM lineitem""")
def scalar_levels(spark, sf):
    t = F.col("l_quantity") * 0.37
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.to_db(F.col("l_tax") * F.col("l_tax")), 6).alias("db"),
        F.round(S.snap_to_frame(t, 24), 6).alias("snapped"), F.round(S.cut_clock(t, 24), 6).alias("clock"),
        S.first_frame(t, 24).alias("first_frame"), S.frame_on_grid(F.col("l_quantity") * 0.25, 0.0, 24, 250).alias("on_grid"),
        F.round(S.held_time(t), 6).alias("held"))


@query("scalar_grid", """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.37 AS t, 60.0 / (60 + l_linenumber * 10) AS beat FROM lineitem)
SELECT l_orderkey, l_linenumber, round((t - 1.3) / (4 * beat), 6) AS bar, round(1.3 + floor((t - 1.3) / beat + 1e-6) * beat, 6) AS last_beat, round(t - (1.3 + floor((t - 1.3) / beat + 1e-6) * beat), 6) AS since,
 ((CAST(floor((t - 1.3) / beat + 1e-6) AS BIGINT) % 4) + 4) % 4 AS beat_in_bar, (((CAST(floor((t - 1.3) / beat + 1e-6) AS BIGINT) % 4) + 4) % 4) IN (1, 3) AS backbeat,
 round(exp(-0.5 * power(log2(60 / beat / 120.0), 2)), 6) AS prior, greatest(60.0, floor(60 / beat * 0.8 / 5) * 5) AS lo, least(200.0, ceil(60 / beat * 1.25 / 5) * 5) AS hi, round(1.3 + (l_linenumber - 2) * 4 * beat, 6) AS bar_at FROM x""")
def scalar_grid(spark, sf):
    t, beat, down = F.col("l_quantity") * 0.37, 60.0 / (60 + F.col("l_linenumber") * 10), F.lit(1.3)
    lo, hi = S.octave_range(60 / beat)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.bar_of(t, down, 4 * beat), 6).alias("bar"), F.round(S.last_beat(t, down, beat), 6).alias("last_beat"),
        F.round(S.since_beat(t, down, beat), 6).alias("since"), S.beat_in_bar(t, down, beat).alias("beat_in_bar"),
        S.is_backbeat(t, down, beat).alias("backbeat"), F.round(S.tempo_prior(60 / beat), 6).alias("prior"), lo.alias("lo"), hi.alias("hi"),
        F.round(S.bar_start(F.col("l_linenumber") - 1, down, 4 * beat), 6).alias("bar_at"))


@query("scalar_easing", """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 40.0 - 0.1 AS v, least(greatest(l_quantity / 40.0 - 0.1, 0), 1) AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, round(u * u * (3 - 2 * u), 6) AS ease, round(u * u * u, 6) AS ease_in, round(1 - power(1 - u, 3), 6) AS ease_out, round(CASE WHEN u < 0.5 THEN 4 * u * u * u ELSE 1 - power(2 - 2 * u, 3) / 2 END, 6) AS ease_in_out,
 round(10 + 20 * least(greatest((v - 0.2) / 0.5, 0), 1), 6) AS remap, round(v - floor(v), 6) AS fract, round(CASE WHEN v < 0.3 THEN 0 WHEN v < 0.4 THEN (v - 0.3) / 0.1 ELSE exp(-(v - 0.3 - 0.1) / 0.25) END, 6) AS hit,
 round(least(greatest((v - 0.8) / -0.6, 0), 1) * least(greatest((v - 0.8) / -0.6, 0), 1) * (3 - 2 * least(greatest((v - 0.8) / -0.6, 0), 1)), 6) AS falling, CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END AS step FROM x""")
def scalar_easing(spark, sf):
    v = F.col("l_quantity") / 40.0 - 0.1
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r(S.ease(v), "ease"), r(S.ease_in(v), "ease_in"), r(S.ease_out(v), "ease_out"), r(S.ease_in_out(v), "ease_in_out"),
        r(S.remap(v, F.lit(0.2), F.lit(0.7), F.lit(10.0), F.lit(30.0)), "remap"), r(S.fract(v), "fract"),
        r(S.hit(v, F.lit(0.3), 0.1, 0.25), "hit"), r(S.smoothstep(0.8, 0.2, v), "falling"), S.smoothstep(0.5, 0.5, v).alias("step"))


@query("scalar_sizes", """WITH x AS (SELECT p_partkey, 400 + p_size * 37 AS sw, 300 + CAST(p_partkey % 61 AS INTEGER) * 29 AS sh, p_size AS num, CAST(power(2, p_partkey % 5) AS INTEGER) AS den, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST((p_partkey % 8) * 6 AS INTEGER) END AS clk FROM part)
SELECT p_partkey, abs(sw * 1920 - sh * 1080) <= 0.01 * sh * 1080 AS same, CASE WHEN sw * 1920 >= sh * 1080 THEN 1080 ELSE least(1080, greatest(2, 2 * CAST(round_even(1920 * sw / sh / 2, 0) AS BIGINT))) END AS fit_w,
 CASE WHEN sw * 1920 >= sh * 1080 THEN least(1920, greatest(2, 2 * CAST(round_even(1080 * sh / sw / 2, 0) AS BIGINT))) ELSE 1920 END AS fit_h,
 CASE WHEN sw * 1920 >= sh * 1080 THEN greatest(1080, greatest(2, 2 * CAST(ceil(1920 * sw / sh / 2 - 1e-9) AS BIGINT))) ELSE 1080 END AS cover_w,
 CASE WHEN sw * 1920 >= sh * 1080 THEN 1920 ELSE greatest(1920, greatest(2, 2 * CAST(ceil(1080 * sh / sw / 2 - 1e-9) AS BIGINT))) END AS cover_h,
 round(CASE WHEN clk IS NOT NULL AND clk <> 24 AND clk >= 6 AND num * 96.0 / den / nullif(clk, 0) >= 1 AND abs(num * 96.0 / den / nullif(clk, 0) - round_even(num * 96.0 / den / nullif(clk, 0), 0)) < 1e-9 THEN clk / 24.0 WHEN den >= 8 AND num > 3 AND num % 3 = 0 THEN 12.0 / den ELSE 4.0 / den END, 6) AS pulse, round(num * 4.0 / den, 6) AS quarters FROM x""")
def scalar_sizes(spark, sf):
    k = F.col("p_partkey")
    x = table(spark, sf, "part").select("p_partkey", (400 + F.col("p_size") * 37).cast("double").alias("sw"), (300 + k % 61 * 29).cast("double").alias("sh"),
                                        F.col("p_size").alias("num"), F.pow(F.lit(2.0), (k % 5).cast("double")).cast("int").alias("den"),
                                        F.when(k % 3 != 0, (k % 8 * 6).cast("int")).alias("clk"))
    sw, sh, fw, fh = F.col("sw"), F.col("sh"), F.lit(1080), F.lit(1920)
    fit, cover = S.fit_size(sw, sh, fw, fh), S.cover_size(sw, sh, fw, fh)
    return x.select("p_partkey", S.same_aspect(sw, sh, fw, fh).alias("same"), fit[0].cast("bigint").alias("fit_w"), fit[1].cast("bigint").alias("fit_h"),
                    cover[0].cast("bigint").alias("cover_w"), cover[1].cast("bigint").alias("cover_h"),
                    F.round(S.pulse_length(F.col("num"), F.col("den"), F.nullif("clk", F.lit(0))), 6).alias("pulse"),
                    F.round(S.quarters_per_bar(F.col("num"), F.col("den")), 6).alias("quarters"))


@query("hue_match", """WITH x AS (SELECT p_partkey, p_size * 3.6 AS hue, (p_partkey % 256) AS r, (p_partkey * 7 % 256) AS g, (p_partkey * 13 % 256) AS b FROM part), m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM x),
h AS (SELECT *, CASE WHEN mx = mn THEN 0.0 WHEN mx = r THEN (g - b) / CAST(mx - mn AS DOUBLE) / 6 WHEN mx = g THEN (2 + (b - r) / CAST(mx - mn AS DOUBLE)) / 6 ELSE (4 + (r - g) / CAST(mx - mn AS DOUBLE)) / 6 END AS s FROM m)
SELECT p_partkey, round((s - floor(s)) * 180, 6) AS target, round(least(abs(hue - (s - floor(s)) * 180), 180 - abs(hue - (s - floor(s)) * 180)), 6) AS distance FROM h""")
def hue_match(spark, sf):
    k = F.col("p_partkey")
    colour = F.format_string("#%02x%02x%02x", k % 256, k * 7 % 256, k * 13 % 256)
    target = S.target_hue(colour, F.lit(0.0))
    return table(spark, sf, "part").select("p_partkey", F.round(target, 6).alias("target"),
                                           F.round(S.hue_distance(F.col("p_size") * 3.6, target), 6).alias("distance"))


@query("channel_fold", """WITH b AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS l, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(l, r), lambda p: abs(p[1] + p[2]) / 2)), 6) AS mid, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE round(list_sum(list_transform(list_zip(l, r), lambda p: abs(p[1] - p[2]) / 2)), 6) END AS side FROM b WHERE vec_id % 5 <> 0
UNION ALL SELECT vec_id, round(list_sum(list_transform(l, lambda x: abs(x))), 6), NULL FROM b WHERE vec_id % 5 = 0""")
def channel_fold(spark, sf):
    """Stereo blocks folded to middle and side; every fifth block is mono."""
    blocks = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    left, right = F.slice("x", 1, 32), F.when(F.col("vec_id") % 5 != 0, F.slice("x", 33, 32))
    size = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v)), 6)
    return blocks.select("vec_id", size(S.mid(left, right)).alias("mid"), size(S.side(left, right)).alias("side"))


@query("hash_noise", "SELECT event_id, CAST('0x' || substr(md5('7|' || event_type || '|' || event_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS noise FROM events")
def hash_noise(spark, sf):
    """Repeatable noise per event: the same in any partitioning."""
    return table(spark, sf, "events").select("event_id", S.hash_noise(7, F.col("event_type"), F.col("event_id")).alias("noise"))


@query("vocal_presence", f"""WITH {WEEKLY}, x AS (SELECT series_id, frame, rmsdb AS m, rmsdb - value * 3 AS s, CASE WHEN series_id % 10 = 0 THEN -70.0 ELSE -10.0 END AS ratio FROM weekly),
c AS (SELECT *, CASE WHEN ratio > -60 AND m > -100 THEN least(greatest(m - s, -30.0), 30.0) END AS c FROM x), q AS (SELECT series_id, quantile_cont(c, 0.05) AS a, quantile_cont(c, 0.995) AS b FROM c GROUP BY 1)
SELECT c.series_id, frame, round(CASE WHEN c IS NULL OR NOT b - a > 1e-9 THEN 0.0 ELSE least(greatest((c - a) / (b - a), 0.0), 1.0) END, 6) AS voc FROM c JOIN q USING (series_id)""")
def vocal_presence(spark, sf):
    x = weekly_levels(spark, sf).select("series_id", "frame", F.col("rmsdb").alias("m"), (F.col("rmsdb") - F.col("value") * 3).alias("s"),
                                        F.when(F.col("series_id") % 10 == 0, -70.0).otherwise(-10.0).alias("ratio"))
    return O.vocal_presence(x, SERIES, "m", "s", "ratio").select("series_id", "frame", *r6("voc"))


@query("centroid_level", f"""WITH {WEEKLY} SELECT series_id, frame, round(CASE WHEN rmsdb <= -100 THEN 0.0 ELSE least(greatest(value * 4000 / 8000, 0.0), 1.0) END, 6) AS cent FROM weekly""")
def centroid_level(spark, sf):
    return weekly_levels(spark, sf).select("series_id", "frame", F.round(S.centroid_level(F.col("value") * 4000, F.col("rmsdb")), 6).alias("cent"))
