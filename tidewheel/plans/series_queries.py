"""Queries over single series: framing, levels, onsets, normalisation, passages, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import aggregates as A
from tidewheel.operators import series as O
from tidewheel.operators.joins import interval_join
from tidewheel.plans.inputs import HOURLY, SERIES, WEEKLY, WEEKLY_FLUX, hourly, weekly, weekly_flux, weekly_levels
from tidewheel.session import settle, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("frame_grid", f"WITH {HOURLY} SELECT series_id, frame, n, round(value, 4) AS value FROM hourly")
def frame_grid(spark, sf):
    return hourly(spark, sf).select("series_id", "frame", "n", F.round("value", 4).alias("value"))


@query("energy_jumps", f"""WITH {HOURLY},
lv AS (SELECT *, greatest(10 * log10(greatest(CASE WHEN n > 0 THEN square / n ELSE 0 END, 1e-30)), -100.0) AS rmsdb FROM hourly),
fx AS (SELECT *, greatest(rmsdb - coalesce(lag(rmsdb) OVER w, rmsdb), 0.0) AS flux FROM lv WINDOW w AS (PARTITION BY series_id ORDER BY frame)),
ov AS (SELECT *, greatest(flux - sum(flux) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50, 0.0) AS o FROM fx),
bx AS (SELECT *, sum(o) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0 AS onset FROM ov),
dd AS (SELECT *, onset - coalesce(lag(onset) OVER (PARTITION BY series_id ORDER BY frame), onset) AS d FROM bx),
st AS (SELECT series_id, avg(d) AS m, stddev_pop(d) AS s FROM dd GROUP BY 1)
SELECT series_id, frame, round(onset, 6) AS onset, round((d - m) / s, 6) AS z FROM dd JOIN st USING (series_id) WHERE (d - m) / s >= 2""")
def energy_jumps(spark, sf):
    """At which hours did each event type's level rise by more than two deviations?"""
    levels = O.level(hourly(spark, sf))
    onset = O.onset_strength(levels, SERIES, level="rmsdb")
    return O.energy_jumps(onset, SERIES, "onset").select("series_id", "frame", *r6("onset", "z"))


@query("onset_strength", f"""WITH {WEEKLY_FLUX},
ov AS (SELECT *, greatest(flux - sum(flux) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50, 0.0) AS o FROM weekly_flux)
SELECT series_id, frame, round(sum(o) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0, 6) AS onset FROM ov""")
def onset_strength(spark, sf):
    return O.onset_strength(weekly_flux(spark, sf), SERIES, "flux").select("series_id", "frame", *r6("onset"))


@query("log_flux", f"""WITH {WEEKLY}, x AS (SELECT *, ln(1 + 100 * value) AS x FROM weekly)
SELECT series_id, frame, round(greatest(x - coalesce(lag(x) OVER (PARTITION BY series_id ORDER BY frame), x), 0.0), 6) AS flux FROM x""")
def log_flux(spark, sf):
    return O.rising(weekly(spark, sf), SERIES, "value", "flux", log_gain=100.0).select("series_id", "frame", *r6("flux"))


_QUIET = """
f AS (SELECT *, rmsdb < -5.0 AS q, lead(t) OVER (PARTITION BY series_id ORDER BY frame) AS nt,
             row_number() OVER (PARTITION BY series_id ORDER BY frame) AS rn FROM weekly),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY series_id, q ORDER BY frame) AS isl FROM f),
p AS (SELECT series_id, min(t) AS s, max(coalesce(nt, t)) AS e, avg(rmsdb) AS m FROM g WHERE q GROUP BY series_id, isl)"""


@query("quiet_passages", f"""WITH {WEEKLY}, {_QUIET}
SELECT series_id, s AS start, e AS "end", round(m, 6) AS mean_db FROM p WHERE e - s >= 3""")
def quiet_passages(spark, sf):
    return O.quiet_passages(weekly_levels(spark, sf), SERIES, "rmsdb", threshold=-5.0, min_duration=3.0).select(
        "series_id", "start", "end", *r6("mean_db"))


@query("consecutive_ranges", f"""WITH {WEEKLY},
d AS (SELECT series_id, frame, frame - row_number() OVER (PARTITION BY series_id ORDER BY frame) AS isl FROM weekly WHERE n > 2)
SELECT series_id, min(frame) AS first, max(frame) AS last FROM d GROUP BY series_id, isl""")
def consecutive_ranges(spark, sf):
    return O.consecutive_ranges(weekly_levels(spark, sf).where("n > 2"), SERIES, "frame")


@query("percentile_normalize", f"""WITH {WEEKLY},
q AS (SELECT series_id, quantile_cont(rmsdb, 0.05) AS a, quantile_cont(rmsdb, 0.995) AS b FROM weekly GROUP BY 1)
SELECT series_id, frame, round(CASE WHEN b - a > 1e-9 THEN least(greatest((rmsdb - a) / (b - a), 0.0), 1.0) ELSE 0.0 END, 6) AS level
FROM weekly JOIN q USING (series_id)""")
def percentile_normalize(spark, sf):
    return O.percentile_normalize(weekly_levels(spark, sf), SERIES, "rmsdb", "level").select("series_id", "frame", *r6("level"))


@query("sounding_normalize", f"""WITH {WEEKLY},
q AS (SELECT series_id, quantile_cont(rmsdb, 0.05) AS a, quantile_cont(rmsdb, 0.995) AS b FROM weekly WHERE rmsdb > -100 GROUP BY 1)
SELECT series_id, frame, round(CASE WHEN rmsdb > -100 AND b - a > 1e-9 THEN least(greatest((rmsdb - a) / (b - a), 0.0), 1.0) ELSE 0.0 END, 6) AS level
FROM weekly LEFT JOIN q USING (series_id)""")
def sounding_normalize(spark, sf):
    return O.sounding_normalize(weekly_levels(spark, sf), SERIES, "rmsdb", "level").select("series_id", "frame", *r6("level"))


@query("flux_normalize", f"""WITH {WEEKLY_FLUX}, q AS (SELECT series_id, quantile_cont(flux, 0.995) AS ref FROM weekly_flux GROUP BY 1)
SELECT series_id, frame, round(CASE WHEN ref > 0 THEN least(greatest(flux / ref, 0.0), 1.5) ELSE 0.0 END, 6) AS level
FROM weekly_flux JOIN q USING (series_id)""")
def flux_normalize(spark, sf):
    return O.flux_normalize(settle(weekly_flux(spark, sf)), SERIES, "flux", "level").select("series_id", "frame", *r6("level"))


@query("relative_level", f"""WITH {WEEKLY}, m AS (SELECT series_id, max(rmsdb) AS p FROM weekly GROUP BY 1)
SELECT series_id, frame, round(greatest(rmsdb - p, -80.0), 6) AS db FROM weekly JOIN m USING (series_id)""")
def relative_level(spark, sf):
    return O.relative_db(weekly_levels(spark, sf), SERIES, "rmsdb", "db").select("series_id", "frame", *r6("db"))


@query("loudest_window", f"""WITH {WEEKLY}, c AS (SELECT series_id, count(*) AS cnt FROM weekly GROUP BY 1),
s AS (SELECT series_id, frame, round(sum(power(10.0, rmsdb / 10.0)) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 79 FOLLOWING), 9) AS s FROM weekly),
b AS (SELECT s.*, row_number() OVER (PARTITION BY s.series_id ORDER BY s DESC, frame) AS rn FROM s JOIN c USING (series_id) WHERE frame + 80 <= cnt OR (cnt <= 80 AND frame = 0)),
w AS (SELECT b.series_id, frame AS start_frame, least(80, cnt) AS length, s AS power, cnt - 80.0 AS latest FROM b JOIN c USING (series_id) WHERE rn = 1)
SELECT series_id, start_frame, CAST(length AS BIGINT) AS length, round(power, 6) AS power,
       round(least(greatest(0.0, 2.0 + 4.0 * least(greatest(round_even((start_frame - 2.0) / 4.0, 0), ceil(-2.0 / 4.0 - 1e-9)), floor((latest - 2.0) / 4.0 + 1e-9))), latest), 6) AS start
FROM w""")
def loudest_window(spark, sf):
    levels = weekly_levels(spark, sf)
    found = O.loudest_window(levels, SERIES, "rmsdb", 80)
    sized = levels.groupBy("series_id").agg((F.count("*") - 80.0).alias("latest"))
    return O.snap_start_to_bar(found.join(sized, SERIES), F.col("start_frame").cast("double"), F.lit(2.0), F.lit(4.0),
                               F.col("latest"), "start").select("series_id", "start_frame", "length", *r6("power", "start"))


@query("audible_span", f"""WITH {WEEKLY}, m AS (SELECT series_id, max(rmsdb) AS p FROM weekly GROUP BY 1)
SELECT series_id, min(frame) AS first_frame, max(frame) AS last_frame FROM weekly JOIN m USING (series_id) WHERE rmsdb > p - 6 GROUP BY 1""")
def audible_span(spark, sf):
    return O.audible_span(weekly_levels(spark, sf), SERIES, "rmsdb", within=6.0)


@query("exponential_smooth", f"""WITH {WEEKLY}
SELECT a.series_id, a.frame, round(sum(0.45 * power(0.55, a.frame - b.frame) * b.value), 6) AS smooth
FROM weekly a JOIN weekly b ON a.series_id = b.series_id AND b.frame BETWEEN a.frame - 63 AND a.frame GROUP BY 1, 2""")
def exponential_smooth(spark, sf):
    return O.exponential_smooth(weekly(spark, sf), SERIES, "value", "smooth").select("series_id", "frame", *r6("smooth"))


@query("auto_gain", f"""WITH {WEEKLY},
y AS (SELECT *, CASE WHEN value > 0 THEN ln(value) - frame * ln(0.99) END AS y FROM weekly),
m AS (SELECT *, exp(greatest(coalesce(max(y) OVER (PARTITION BY series_id ORDER BY frame), ln(1e-3) + ln(0.99)), ln(1e-3) + ln(0.99)) + frame * ln(0.99)) AS ref FROM y)
SELECT series_id, frame, round(ref, 6) AS gain_ref, round(least(greatest(value / ref, 0.0), 1.0), 6) AS gain FROM m""")
def auto_gain(spark, sf):
    return O.auto_gain(weekly_levels(spark, sf), SERIES, "value", "gain", decay=0.99).select(
        "series_id", "frame", *r6("gain_ref", "gain"))


@query("sliding_sum_wide", f"""WITH {WEEKLY}
SELECT series_id, frame, round(sum(value) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 70 PRECEDING AND 30 FOLLOWING), 6) AS total FROM weekly""")
def sliding_sum_wide(spark, sf):
    from tidewheel.operators.blocks import sliding_sum

    return sliding_sum(weekly(spark, sf), SERIES, "frame", "value", "total", -70, 30).select(
        "series_id", "frame", *r6("total"))


@query("vector_novelty", """
WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(embedding, lambda y: CAST(y AS DOUBLE)))) AS c,
                  list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS total FROM embeddings),
p AS (SELECT *, lag(c) OVER w AS pc, lag(total) OVER w AS pt, max(total) OVER (PARTITION BY label) AS top FROM c WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, round(CASE WHEN pc IS NULL OR total <= top * 1e-6 OR pt <= top * 1e-6 THEN 0.0
  ELSE 1 - list_dot_product(c, pc) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(pc, pc))) END, 6) AS novelty FROM p""")
def vector_novelty(spark, sf):
    return O.cosine_novelty(table(spark, sf, "embeddings"), ["label"], "embedding", "vec_id").select(
        "label", "vec_id", *r6("novelty"))


@query("legacy_scales", f"""WITH {WEEKLY}, x AS (SELECT series_id, frame, CASE WHEN series_id % 2 = 0 THEN value * 50 ELSE value / 10.37 END AS v, value * 400 AS hz FROM weekly),
m AS (SELECT series_id, max(v) FILTER (WHERE frame < 100) > 1.5 AS bytes, max(hz) > 1.5 AS in_hz FROM x GROUP BY 1)
SELECT series_id, frame, round(least(greatest(v / CASE WHEN bytes THEN 255.0 ELSE 1.0 END, 0.0), 1.0), 6) AS v,
       round(least(greatest(hz / CASE WHEN bytes THEN 255.0 WHEN in_hz THEN 8000.0 ELSE 1.0 END, 0.0), 1.0), 6) AS hz FROM x JOIN m USING (series_id)""")
def legacy_scales(spark, sf):
    stored = weekly(spark, sf).select("series_id", "frame", F.when(F.col("series_id") % 2 == 0, F.col("value") * 50)
                                      .otherwise(F.col("value") / 10.37).alias("v"), (F.col("value") * 400).alias("hz"))
    return O.read_scales(stored, SERIES, "v", "v", "hz", head=100).select("series_id", "frame", *r6("v", "hz"))


@query("stride_rows", f"""WITH {WEEKLY}, c AS (SELECT series_id, count(*) AS cnt FROM weekly GROUP BY 1)
SELECT series_id, frame, round(value, 6) AS value FROM weekly JOIN c USING (series_id) WHERE frame % greatest(1, cnt // 100) = 0""")
def stride_rows(spark, sf):
    return O.stride_rows(weekly(spark, sf), SERIES, 100).select("series_id", "frame", *r6("value"))


_SECTIONS = "sections AS (SELECT series_id, k AS section, k * 60.0 AS s, (k + 1) * 60.0 AS e FROM (SELECT series_id, unnest(range(0, CAST(max(frame) AS BIGINT) // 60 + 1)) AS k FROM weekly GROUP BY series_id))"


def fixed_sections(spark, sf):
    """Sections of 60 weeks from the start of each series to its end."""
    last = weekly_levels(spark, sf).groupBy("series_id").agg(F.floor(F.max("frame") / 60).cast("bigint").alias("last"))
    return last.select("series_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("section")).select(
        "series_id", "section", (F.col("section") * 60.0).alias("start"), ((F.col("section") + 1) * 60.0).alias("end"))


@query("section_loudness", f"""WITH {WEEKLY}, {_SECTIONS}, m AS (SELECT series_id, min(rmsdb) AS lo, max(rmsdb) AS hi FROM weekly GROUP BY 1)
SELECT s.series_id, s.section, round(coalesce((avg(w.rmsdb) - max(lo)) / (CASE WHEN max(hi - lo) = 0 THEN 1 ELSE max(hi - lo) END), 0.5), 6) AS loudness
FROM sections s JOIN m USING (series_id) LEFT JOIN weekly w ON w.series_id = s.series_id AND w.t >= s.s AND w.t < s.e GROUP BY 1, 2""")
def section_loudness(spark, sf):
    return A.section_loudness(weekly_levels(spark, sf), fixed_sections(spark, sf), SERIES, "t", "rmsdb", 60.0).select(
        "series_id", "section", *r6("loudness"))


@query("section_distribution", f"""WITH {WEEKLY}, {_SECTIONS},
x AS (SELECT s.series_id, s.section, w.value AS v, row_number() OVER (PARTITION BY s.series_id, s.section ORDER BY w.value) AS rn,
             count(*) OVER (PARTITION BY s.series_id, s.section) AS n
      FROM sections s JOIN weekly w ON w.series_id = s.series_id AND w.t >= s.s AND w.t < s.e)
SELECT series_id, section, round(floor(round(avg(v), 9) / 0.05 + 0.5) * 0.05, 6) AS mean,
       round(floor(round(max(CASE WHEN rn = floor(0.95 * (n - 1) + 0.5) + 1 THEN v END), 9) / 0.05 + 0.5) * 0.05, 6) AS p95,
       round(floor(round(max(v), 9) / 0.05 + 0.5) * 0.05, 6) AS max FROM x GROUP BY 1, 2""")
def section_distribution(spark, sf):
    placed = settle(interval_join(weekly_levels(spark, sf), fixed_sections(spark, sf), SERIES, "t", "start", "end", 60.0))
    raw = A.section_distribution(placed, ["series_id", "section"], "value", step=None)
    step = lambda c: F.round(F.floor(F.round(c, 9) / 0.05 + 0.5) * 0.05, 6).alias(c)
    return raw.select("series_id", "section", step("mean"), step("p95"), step("max"))


@query("tile_means", f"""WITH {WEEKLY}, m AS (SELECT series_id, count(*) AS n, min(rmsdb) AS lo, max(rmsdb) AS hi FROM weekly GROUP BY 1),
k AS (SELECT series_id, n, lo, hi, k, n * k // 7 AS a, n * (k + 1) // 7 AS b FROM m, range(0, 7) r(k))
SELECT k.series_id, k.k AS tile, round(coalesce(avg((rmsdb - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END), 0.0), 6) AS level
FROM k LEFT JOIN weekly w ON w.series_id = k.series_id AND w.frame >= a AND w.frame < b GROUP BY 1, 2""")
def tile_means(spark, sf):
    return A.tile_means(weekly_levels(spark, sf), SERIES, "rmsdb", 7).select("series_id", "tile", *r6("level"))


@query("bar_evidence", f"""WITH {WEEKLY_FLUX}, sz AS (SELECT series_id, count(*) AS cnt, avg(abs(flux)) AS sf, avg(abs(value)) AS sv FROM weekly_flux GROUP BY 1),
b AS (SELECT w.series_id, frame // 4 AS bar, frame % 4 AS pos, cnt // 4 AS bars,
        (flux - avg(flux) OVER (PARTITION BY w.series_id, frame // 4)) / sf + (value - avg(value) OVER (PARTITION BY w.series_id, frame // 4)) / sv AS e
      FROM weekly_flux w JOIN sz USING (series_id) WHERE frame // 4 < cnt // 4),
p AS (SELECT series_id, pos, round(avg(e) / greatest(stddev_samp(e) / sqrt(max(bars)), 1e-3), 9) AS t FROM b GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC, pos) AS rn FROM p),
bl AS (SELECT series_id, bar // 4 AS blk, pos, round(avg(e), 9) AS m FROM b GROUP BY 1, 2, 3),
bk AS (SELECT *, row_number() OVER (PARTITION BY series_id, blk ORDER BY m DESC, pos) AS rn FROM bl),
bb AS (SELECT series_id, blk, max(CASE WHEN rn = 1 THEN m END) - max(CASE WHEN rn = 2 THEN m END) AS gap, max(CASE WHEN rn = 1 THEN pos END) AS top FROM bk GROUP BY 1, 2),
w AS (SELECT series_id, max(CASE WHEN rn = 1 THEN pos END) AS winner, max(CASE WHEN rn = 2 THEN pos END) AS runner_up FROM k GROUP BY 1)
SELECT w.series_id, CAST(winner AS INTEGER) AS winner, CAST(runner_up AS INTEGER) AS runner_up, round(avg(CASE WHEN gap > 0.05 AND top = winner THEN 1.0 ELSE 0.0 END), 2) AS confidence
FROM w JOIN bb USING (series_id) GROUP BY 1, 2, 3""")
def bar_evidence(spark, sf):
    beats = settle(weekly_flux(spark, sf)).withColumnRenamed("frame", "idx")
    return A.beat_of_bar_evidence(beats, SERIES, ["flux", "value"])


@query("pearson_group", """WITH g AS (SELECT l_suppkey AS series_id, corr(l_quantity, l_extendedprice) AS r, stddev_pop(l_quantity) AS a, stddev_pop(l_extendedprice) AS b FROM lineitem GROUP BY 1)
SELECT series_id, round(CASE WHEN a >= 1e-6 AND b >= 1e-6 THEN r END, 6) AS r FROM g""")
def pearson_group(spark, sf):
    return A.pearson(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "series_id"), SERIES,
                     "l_quantity", "l_extendedprice").select("series_id", *r6("r"))


@query("majority_lag", """
WITH m AS (SELECT p_brand, p_partkey, round(p_size * 0.01, 2) AS lag FROM part),
c AS (SELECT a.p_brand, a.lag, count(*) AS cnt FROM (SELECT DISTINCT p_brand, lag FROM m) a JOIN m b ON a.p_brand = b.p_brand AND abs(a.lag - b.lag) <= 0.0201 GROUP BY 1, 2),
t AS (SELECT p_brand, lag AS c, cnt, row_number() OVER (PARTITION BY p_brand ORDER BY cnt DESC, lag DESC) AS rn FROM c),
k AS (SELECT m.*, t.c, t.cnt, count(*) OVER (PARTITION BY m.p_brand) AS n, abs(m.lag - t.c) <= 0.0201 AS inn FROM m JOIN t ON m.p_brand = t.p_brand AND rn = 1),
d AS (SELECT p_brand, quantile_cont(lag, 0.5) AS med FROM k WHERE inn GROUP BY 1)
SELECT p_brand, p_partkey, lag, CASE WHEN 2 * cnt > n THEN round(med, 6) END AS agreed, NOT (2 * cnt > n AND inn) AS outlier FROM k JOIN d USING (p_brand)""")
def majority_lag(spark, sf):
    lags = table(spark, sf, "part").select("p_brand", "p_partkey", F.round(F.col("p_size") * 0.01, 2).alias("lag"))
    return A.majority(lags, ["p_brand"], "lag", "p_partkey", radius=0.0201).select(
        "p_brand", "p_partkey", "lag", F.round("agreed", 6).alias("agreed"), "outlier")


@query("weighted_level", """SELECT l_returnflag, round(10 * log10(greatest(sum(l_tax * l_tax), 1e-30) / greatest(sum(l_discount * l_discount), 1e-30)), 6) AS side_to_mid_db FROM lineitem GROUP BY 1""")
def weighted_level(spark, sf):
    power = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_tax") * F.col("l_tax")).alias("s"),
                                                (F.col("l_discount") * F.col("l_discount")).alias("m"))
    return A.weighted_level(power, ["l_returnflag"], "s", "m").select("l_returnflag", *r6("side_to_mid_db"))


@query("metric_medians", """
WITH r AS (SELECT l_returnflag AS suite, l_linestatus AS "case", l_linenumber AS run, round(avg(l_quantity), 6) AS fps, round(max(l_tax), 6) AS tax,
                  CASE WHEN l_linenumber > 2 THEN CAST(count(*) AS DOUBLE) END AS extra FROM lineitem GROUP BY 1, 2, 3),
u AS (SELECT suite, "case", run, 'fps' AS metric, fps AS v FROM r UNION ALL SELECT suite, "case", run, 'tax', tax FROM r UNION ALL SELECT suite, "case", run, 'extra', extra FROM r),
n AS (SELECT suite, "case", count(DISTINCT run) AS runs FROM r GROUP BY 1, 2)
SELECT u.suite, u."case", metric, round(quantile_cont(v, 0.5), 4) AS median FROM u JOIN n USING (suite, "case") WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT run) = max(runs)""")
def metric_medians(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("suite"), F.col("l_linestatus").alias("case"),
                                                F.col("l_linenumber").alias("run")).agg(
        F.round(F.avg("l_quantity"), 6).alias("fps"), F.round(F.max("l_tax"), 6).alias("tax"), F.count("*").cast("double").alias("extra"))
    named = runs.select("suite", "case", "run", F.create_map(
        F.lit("fps"), F.col("fps"), F.lit("tax"), F.col("tax"), F.lit("extra"), F.when(F.col("run") > 2, F.col("extra"))).alias("metrics"))
    return A.metric_medians(named, ["suite", "case"], "run", "metrics")


@query("profile_summary", """WITH s AS (SELECT user_id, event_type AS kind, count(*) AS calls, round(sum(value / 7), 1) AS ms FROM events GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, kind) AS INTEGER) AS place FROM s""")
def profile_summary(spark, sf):
    return A.profile_summary(table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), (F.col("value") / 7).alias("value")), ["user_id"], "kind", "value", "event_id")


@query("profile_split", """WITH e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'v=copy|a=aac' WHEN event_id % 3 = 1 THEN 'a=copy|null' ELSE 'probe' END AS kind, value / 7 AS value FROM events)
SELECT user_id, count(*) FILTER (WHERE kind LIKE '%a=aac%') AS audio_encodes, round(coalesce(sum(value) FILTER (WHERE kind LIKE '%a=aac%'), 0), 1) AS audio_encode_ms,
       round(coalesce(sum(value) FILTER (WHERE kind LIKE '%null%'), 0), 1) AS measure_ms FROM e GROUP BY 1""")
def profile_split(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "v=copy|a=aac").when(F.col("event_id") % 3 == 1, "a=copy|null").otherwise("probe")
    calls = table(spark, sf, "events").select("user_id", "event_id", kind.alias("kind"), F.lit(1).cast("bigint").alias("calls"), (F.col("value") / 7).alias("value"))
    return A.profile_split(calls, ["user_id"], "kind", "calls", "value", "event_id")


@query("knee", """WITH g AS (SELECT l_suppkey AS series_id, l_linenumber AS workers, round(avg(l_quantity), 6) AS fps FROM lineitem GROUP BY 1, 2), b AS (SELECT series_id, max(fps) AS best FROM g GROUP BY 1)
SELECT series_id, min(workers) AS knee, max(best) AS best FROM g JOIN b USING (series_id) WHERE fps >= 0.95 * best GROUP BY 1""")
def knee(spark, sf):
    rates = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("series_id"), F.col("l_linenumber").alias("workers")).agg(
        F.round(F.avg("l_quantity"), 6).alias("fps"))
    return A.knee(rates, SERIES, "workers", "fps")


@query("pitch_class_sets", "SELECT event_type, CAST(bit_or(CAST(1 << CAST(user_id % 12 AS INTEGER) AS INTEGER)) AS INTEGER) AS mask FROM events GROUP BY 1")
def pitch_class_sets(spark, sf):
    return A.pitch_class_sets(table(spark, sf, "events"), ["event_type"], "user_id")


@query("delivery_summary", """SELECT l_orderkey, count(*) AS files, max(l_tax) AS true_peak_max, round(avg(-10 - l_quantity / 7), 2) AS lufs_mean FROM lineitem GROUP BY 1""")
def delivery_summary(spark, sf):
    return A.delivery_summary(table(spark, sf, "lineitem").withColumn("lufs", -10 - F.col("l_quantity") / 7),
                              ["l_orderkey"], "l_tax", "lufs")


@query("top_k_per_group", """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5""")
def top_k_per_group(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return A.top_k(lines, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5)


@query("mood_line", """WITH k AS (SELECT o_custkey, o_orderkey, o_orderpriority || ', made of -- ' || o_orderstatus || '.' AS d FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3)
SELECT o_custkey, string_agg(lower(split_part(split_part(d, ',', 1), ' -- ', 1)), ', ' ORDER BY o_orderkey) AS mood FROM k GROUP BY 1""")
def mood_line(spark, sf):
    looks = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat(
        "o_orderpriority", F.lit(", made of -- "), "o_orderstatus", F.lit(".")).alias("d"))
    return A.mood_line(looks, ["o_custkey"], "o_orderkey", "d")
