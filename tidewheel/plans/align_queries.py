"""Queries that align and compare two versions of each series, and search for tempo."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import aggregates as A
from tidewheel.operators import align as L
from tidewheel.operators import series as O
from tidewheel.operators import slopes
from tidewheel.operators.blocks import join_keys, over_blocks
from tidewheel.operators.joins import lined_up, sample_linear, spread_index
from tidewheel.plans.inputs import SERIES, VERSIONS, WEEKLY, WEEKLY_FLUX, versions, weekly, weekly_flux, weekly_levels
from tidewheel.session import settle, table

QUERIES, ORACLES = {}, {}
REACH, FPS = 8, 1.0


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def curve_sql(name, src, keys, a, b, sizes, reach):
    k = ", ".join(f"o.{x}" for x in keys)
    on = " AND ".join(f"o.{x} = n.{x}" for x in keys)
    plain = ", ".join(keys)
    return f"""
{name}_m AS (
  SELECT {k}, r.lag AS lag, count(*) AS n, sum(o.{a}) AS sa, sum(n.{b}) AS sb, sum(o.{a} * o.{a}) AS saa, sum(n.{b} * n.{b}) AS sbb, sum(o.{a} * n.{b}) AS sab
  FROM {src} o, range(-{reach}, {reach + 1}) r(lag), {src} n
  WHERE {on} AND n.frame = o.frame + r.lag AND o.{a} IS NOT NULL AND n.{b} IS NOT NULL GROUP BY ALL),
{name} AS (
  SELECT {plain}, lag, CASE WHEN n >= greatest(1, least(na, nb) // 2) AND saa - sa * sa / n > 1e-9 AND sbb - sb * sb / n > 1e-9
     THEN (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) ELSE -1.0 END AS r
  FROM {name}_m JOIN {sizes} USING ({plain}))"""


def best_sql(name, curve, keys):
    k = ", ".join(keys)
    return f"""
{name} AS (
  WITH p AS (SELECT *, lag(r) OVER w AS l, lead(r) OVER w AS g, max(r) OVER (PARTITION BY {k}) AS top FROM {curve} WINDOW w AS (PARTITION BY {k} ORDER BY lag))
  SELECT {k}, lag, r FROM p WHERE r >= coalesce(l, -9) AND r >= coalesce(g, -9) AND r >= top - 0.002
  QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY abs(lag), lag) = 1)"""


CURVE = VERSIONS + "," + curve_sql("curve", "versions", SERIES, "old", "new", "vsize", REACH)
BEST = CURVE + "," + best_sql("best", "curve", SERIES)


def curve(pairs):
    return L.offset_curve(pairs, SERIES, REACH)


def offsets(pairs):
    return settle(L.global_offset(pairs, SERIES, REACH))


@query("offset_curve", f"WITH {CURVE} SELECT series_id, CAST(lag AS INTEGER) AS lag, round(r, 6) AS r FROM curve")
def offset_curve(spark, sf):
    return curve(versions(spark, sf)).select("series_id", "lag", F.round("r", 6).alias("r"))


@query("global_offset", f"WITH {BEST} SELECT series_id, CAST(lag AS INTEGER) AS lag, round(r, 3) AS r FROM best")
def global_offset(spark, sf):
    return offsets(versions(spark, sf))


@query("refined_offset", f"""WITH {BEST}, p AS (SELECT *, lag(r) OVER w AS l, lead(r) OVER w AS g FROM curve WINDOW w AS (PARTITION BY series_id ORDER BY lag))
SELECT b.series_id, round(b.lag + CASE WHEN least(l, p.r, g) > -1 AND l IS NOT NULL AND g IS NOT NULL AND l - 2 * p.r + g < 0 THEN least(greatest(0.5 * (l - g) / (l - 2 * p.r + g), -0.5), 0.5) ELSE 0.0 END, 6) AS lag_s
FROM best b JOIN p ON b.series_id = p.series_id AND b.lag = p.lag""")
def refined_offset(spark, sf):
    lags = settle(curve(versions(spark, sf)))
    best = L.best_lag(lags, SERIES)
    return L.refine_peak(lags, best, SERIES, FPS).select("series_id", F.round("lag_s", 6).alias("lag_s"))


@query("best_and_runner_up", f"""WITH {CURVE}, p AS (SELECT *, lag(r) OVER w AS l, lead(r) OVER w AS g FROM curve WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY r DESC, lag) = 1),
o AS (SELECT p.series_id, p.lag, p.r FROM p JOIN b ON p.series_id = b.series_id WHERE p.r >= p.l AND p.r >= p.g AND abs(p.lag - b.lag) > 2 QUALIFY row_number() OVER (PARTITION BY p.series_id ORDER BY p.r DESC, p.lag) = 1)
SELECT b.series_id, round(b.lag + CASE WHEN b.l IS NOT NULL AND b.g IS NOT NULL AND b.l - 2 * b.r + b.g < 0 THEN 0.5 * (b.l - b.g) / (b.l - 2 * b.r + b.g) ELSE 0.0 END, 6) AS lag,
       round(b.r, 6) AS r, (b.l IS NULL OR b.g IS NULL) AS edge, round(b.r - o.r, 6) AS margin, CAST(o.lag AS INTEGER) AS runner_up FROM b LEFT JOIN o USING (series_id)""")
def best_and_runner_up(spark, sf):
    return L.best_and_runner_up(curve(versions(spark, sf)), SERIES, 2).select(
        "series_id", F.round("lag", 6).alias("lag"), F.round("r", 6).alias("r"), "edge", F.round("margin", 6).alias("margin"), "runner_up")


WIDTH, HOP, SEARCH = 48, 24, 6
LOCAL = VERSIONS + f""",
starts AS (SELECT series_id, unnest(range(0, greatest(1, na - {WIDTH} + 1), {HOP})) AS start FROM vsize),
wins AS (SELECT s.series_id, s.start, v.frame, v.old AS a FROM starts s JOIN versions v ON v.series_id = s.series_id AND v.frame >= s.start AND v.frame < s.start + {WIDTH} AND v.old IS NOT NULL),
wr AS (SELECT w.series_id, w.start, l.lag, stddev_pop(a) AS sa, corr(a, coalesce(n.new, -100.0)) AS r, stddev_pop(coalesce(n.new, -100.0)) AS sb
  FROM wins w CROSS JOIN range(-{SEARCH}, {SEARCH + 1}) l(lag) LEFT JOIN versions n ON n.series_id = w.series_id AND n.frame = w.frame + l.lag GROUP BY ALL),
wcurve AS (SELECT series_id, start, lag, CASE WHEN sb > 1e-7 THEN r ELSE 0.0 END AS r FROM wr WHERE sa >= 1.0),""" + best_sql("wbest", "wcurve", ["series_id", "start"]) + """,
lags AS (SELECT s.series_id, s.start, CASE WHEN r >= 0.3 THEN lag END AS lag, round(r, 3) AS r FROM starts s LEFT JOIN wbest b USING (series_id, start))"""


def windows(pairs):
    return settle(L.local_lags(pairs, SERIES, WIDTH, HOP, SEARCH))


@query("local_lags", f"WITH {LOCAL} SELECT series_id, start, CAST(lag AS INTEGER) AS lag, r FROM lags")
def local_lags(spark, sf):
    return windows(versions(spark, sf))


THEIL = """
th AS (SELECT a.series_id, quantile_cont((b.lag - a.lag) / CAST(b.start - a.start AS DOUBLE), 0.5) AS slope FROM lags a JOIN lags b ON a.series_id = b.series_id AND a.start < b.start WHERE a.lag IS NOT NULL AND b.lag IS NOT NULL GROUP BY 1)"""


@query("theil_sen", f"WITH {LOCAL}, {THEIL} SELECT l.series_id, round(coalesce(max(slope), 0.0), 9) AS slope FROM lags l LEFT JOIN th USING (series_id) WHERE lag IS NOT NULL GROUP BY 1")
def theil_sen(spark, sf):
    return slopes.theil_sen(windows(versions(spark, sf)), SERIES, "start", "lag").select("series_id", F.round("slope", 9).alias("slope"))


CLASSIFY = LOCAL + "," + curve_sql("curve", "versions", SERIES, "old", "new", "vsize", REACH) + "," + best_sql("best", "curve", SERIES) + "," + THEIL + """,
x AS (SELECT l.*, CAST(b.lag AS DOUBLE) AS off, round(b.r, 3) AS off_r, coalesce(slope, 0.0) AS slope FROM lags l JOIN best b USING (series_id) LEFT JOIN th USING (series_id)),
lv AS (SELECT series_id, quantile_cont(lag - slope * start, 0.5) AS level FROM x WHERE lag IS NOT NULL GROUP BY 1),
cl AS (SELECT series_id, count(*) AS windows, count(lag) AS matched, count(r) AS voting, max(off) AS off, max(off_r) AS off_r,
   avg(CASE WHEN lag IS NOT NULL THEN CASE WHEN abs(lag - off) <= 0.02 THEN 1.0 ELSE 0.0 END END) AS agree,
   avg(CASE WHEN lag IS NOT NULL THEN CASE WHEN abs(lag) <= 0.02 THEN 1.0 ELSE 0.0 END END) AS at_zero,
   count(*) FILTER (WHERE lag IS NOT NULL AND abs(lag - off) > 0.02) AS moved,
   max(start) FILTER (WHERE lag IS NOT NULL) - min(start) FILTER (WHERE lag IS NOT NULL) AS span,
   avg(CASE WHEN lag IS NOT NULL THEN CASE WHEN abs(lag - slope * start - level) <= 0.02 THEN 1.0 ELSE 0.0 END END) AS on_line, max(slope) AS slope
  FROM x LEFT JOIN lv USING (series_id) GROUP BY 1),
kinds AS (SELECT *, CASE WHEN matched = 0 THEN 'unconfirmed' WHEN agree = 1 AND matched >= voting / 2.0 THEN 'shift'
   WHEN off_r >= 0.8 AND (at_zero = 1 OR agree >= 2.0 / 3 OR (abs(off) > 6 AND (at_zero < 1.0 / 3 OR off_r >= 0.9))) THEN 'shift'
   WHEN matched >= 3 AND span > 0 AND on_line >= 0.7 AND abs(slope) * span > 0.02 THEN 'tempo'
   WHEN moved = 0 THEN 'unconfirmed' ELSE 'moved' END AS kind FROM cl)"""


def kinds(pairs):
    return L.classify_lags(windows(pairs), offsets(pairs), SERIES, FPS, search_s=6.0)


@query("classify_lags", f"WITH {CLASSIFY} SELECT series_id, kind, off AS \"offset\", off_r AS offset_r, matched, windows, round(agree, 6) AS agree, round(slope, 9) AS slope FROM kinds")
def classify_lags(spark, sf):
    return kinds(versions(spark, sf)).select("series_id", "kind", "offset", "offset_r", "matched", "windows",
                                   F.round("agree", 6).alias("agree"), F.round("slope", 9).alias("slope"))


# ---- reading the new version on the old frames, at a lag between frames
def shifted(pairs, by=0.25):
    return offsets(pairs).select("series_id", (F.col("lag") + F.lit(by)).alias("lag"))


ALIGNED = BEST + """,
lg AS (SELECT b.series_id, b.lag + 0.25 AS lag, na, nb FROM best b JOIN vsize USING (series_id)),
sp AS (SELECT series_id, lag, na, nb, unnest(range(0, greatest(na, CAST(ceil(nb - lag) AS BIGINT)))) AS frame FROM lg),
al AS (SELECT s.series_id, s.frame, o.old, CASE WHEN s.frame + lag >= 0 AND s.frame + lag <= nb - 1
          THEN n0.new + (coalesce(n1.new, n0.new) - n0.new) * (s.frame + lag - floor(s.frame + lag)) END AS new,
          (s.frame + lag >= 0 AND s.frame + lag <= nb - 1 AND s.frame < na) AS "both"
  FROM sp s LEFT JOIN versions o ON o.series_id = s.series_id AND o.frame = s.frame
  LEFT JOIN versions n0 ON n0.series_id = s.series_id AND n0.frame = CAST(floor(s.frame + lag) AS BIGINT) AND n0.new IS NOT NULL
  LEFT JOIN versions n1 ON n1.series_id = s.series_id AND n1.frame = CAST(floor(s.frame + lag) AS BIGINT) + 1 AND n1.new IS NOT NULL),
fl AS (SELECT series_id, frame, coalesce(old, -100.0) AS old, coalesce(new, -100.0) AS new, "both" FROM al)"""


@query("aligned_pair", f'WITH {ALIGNED} SELECT series_id, frame, round(old, 6) AS old, round(new, 6) AS new, "both" FROM fl')
def aligned_pair(spark, sf):
    return filled(versions(spark, sf)).select("series_id", "frame", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "both")


@query("onset_alignment", f"""WITH {ALIGNED} SELECT l.series_id, round(coalesce(max(r), 0.0), 6) AS r FROM lg l LEFT JOIN
 (SELECT series_id, CASE WHEN count(*) >= 2 AND stddev_pop(old) >= 1e-12 AND stddev_pop(new) >= 1e-12 THEN corr(old, new) ELSE 0.0 END AS r FROM al WHERE "both" GROUP BY 1) USING (series_id) GROUP BY 1""")
def onset_alignment(spark, sf):
    pairs = versions(spark, sf)
    return L.onset_alignment(pairs, shifted(pairs), SERIES, FPS).select("series_id", F.round("r", 6).alias("r"))


GRID = """
barred AS (SELECT *, CAST(floor((frame - 2.0) / 32.0 + 1e-9) AS BIGINT) + 1 AS bar FROM fl)"""


def grids(pairs):
    return settle(pairs.select("series_id").distinct().select(
        "series_id", F.lit(2.0).alias("downbeat"), F.lit(32.0).alias("bar_s")))


def filled(pairs):
    return settle(L.aligned_pair(pairs, shifted(pairs), SERIES, fill=-100.0, fps=FPS))


@query("section_match", f"""WITH {ALIGNED}, {GRID}, pk AS (SELECT series_id, max(old) AS p FROM fl WHERE "both" GROUP BY 1),
s AS (SELECT b.*, CASE WHEN bar <= 0 THEN 0 ELSE (bar - 1) // 8 * 8 + 1 END AS sec, old > p - 50 AS snd FROM barred b JOIN pk USING (series_id)),
r AS (SELECT series_id, sec, min(bar) AS first_bar, max(bar) AS last_bar, count(*) AS frames,
  CASE WHEN count(*) FILTER (WHERE "both") >= 2 AND avg(CASE WHEN snd THEN 1.0 ELSE 0.0 END) >= 0.5 AND stddev_pop(old) FILTER (WHERE "both") >= 1e-6 AND stddev_pop(new) FILTER (WHERE "both") >= 1e-6
   THEN round(corr(old, new) FILTER (WHERE "both"), 3) END AS r FROM s GROUP BY 1, 2)
SELECT series_id, first_bar, last_bar, frames, r AS vocal_r, r AS mix_r FROM r WHERE frames >= 2""")
def section_match(spark, sf):
    pairs = versions(spark, sf)
    moved = filled(pairs)
    return L.section_matches(moved, moved, grids(pairs), SERIES, FPS)


SCALED = ALIGNED + """,
tops AS (SELECT series_id, max(old) AS t_o, max(new) AS t_n FROM fl GROUP BY 1),
jt AS (SELECT f.series_id, count(*) AS m, quantile_cont(new - old, 0.5) AS g FROM fl f JOIN tops USING (series_id)
       WHERE old > t_o - 50 AND new > t_n - 50 AND old > -100 AND new > -100 GROUP BY 1),
sq AS (SELECT series_id, quantile_cont(old, 0.05) AS lo, quantile_cont(old, 0.995) AS hi FROM versions WHERE old IS NOT NULL GROUP BY 1),
sc AS (SELECT f.series_id, f.frame, CASE WHEN hi - lo > 1e-9 THEN least(greatest((old - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END AS old,
   CASE WHEN hi - lo > 1e-9 THEN least(greatest((new - CASE WHEN m >= 100 THEN g ELSE 0.0 END - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END AS new
  FROM fl f LEFT JOIN jt USING (series_id) JOIN sq USING (series_id))"""


def scaled(pairs, moved):
    raw = pairs.where("old IS NOT NULL").select("series_id", "old")
    return settle(L.common_scale(moved, raw, SERIES))


@query("common_scale", f"WITH {SCALED} SELECT series_id, frame, round(old, 6) AS old, round(new, 6) AS new FROM sc")
def common_scale(spark, sf):
    pairs = versions(spark, sf)
    return scaled(pairs, filled(pairs)).select("series_id", "frame", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"))


LEVELS = SCALED + """,
en AS (SELECT series_id, arg_min(new, frame) AS f0, arg_max(new, frame) AS f1 FROM sc GROUP BY 1),
mv AS (SELECT s.series_id, CAST(floor((frame - 2.0) / 32.0 + 1e-9) AS BIGINT) + 1 AS bar, old, new,
         coalesce(lag(new) OVER w, f0) AS m1, coalesce(lead(new) OVER w, f1) AS m2 FROM sc s JOIN en USING (series_id) WINDOW w AS (PARTITION BY s.series_id ORDER BY frame)),
lst AS (SELECT series_id, bar, count(*) AS n, least(avg(abs(old - new)), avg(abs(old - m1)), avg(abs(old - m2))) AS delta,
   nullif(greatest(coalesce(CASE WHEN stddev_pop(old) > 0.03 AND stddev_pop(new) > 0.03 AND count(*) >= 2 THEN corr(old, new) END, -9),
            coalesce(CASE WHEN stddev_pop(old) > 0.03 AND stddev_pop(m1) > 0.03 AND count(*) >= 2 THEN corr(old, m1) END, -9),
            coalesce(CASE WHEN stddev_pop(old) > 0.03 AND stddev_pop(m2) > 0.03 AND count(*) >= 2 THEN corr(old, m2) END, -9)), -9) AS r
  FROM mv GROUP BY 1, 2),
fresh AS (SELECT series_id, CAST(floor((frame - 2.0) / 32.0 + 1e-9) AS BIGINT) + 1 AS bar, avg(CASE WHEN new > 0.35 AND old < 0.15 THEN 1.0 ELSE 0.0 END) AS v FROM sc GROUP BY 1, 2)"""


@query("level_changes", f"WITH {LEVELS} SELECT series_id, bar, round(delta, 6) AS delta, round(r, 6) AS r FROM lst")
def level_changes(spark, sf):
    pairs = versions(spark, sf)
    return L.level_changes(scaled(pairs, filled(pairs)), grids(pairs), SERIES, 1, FPS).select(
        "series_id", "bar", F.round("delta", 6).alias("delta"), F.round("r", 6).alias("r"))


RHYTHM = ALIGNED + """,
pw AS (SELECT series_id, frame, power(10.0, old / 10) AS old, power(10.0, new / 10) AS new FROM fl),
sl AS (SELECT *, CAST(floor((frame - 1.0) / 2.0 + 1e-9) AS BIGINT) AS slot16 FROM pw),
pr AS (SELECT series_id, CAST(floor(slot16 / 16.0) AS BIGINT) + 1 AS bar, slot16 - 16 * CAST(floor(slot16 / 16.0) AS BIGINT) AS slot, sum(old) AS o, sum(new) AS n FROM sl GROUP BY ALL),
bt AS (SELECT series_id, bar, sum(o) AS t_o, sum(n) AS t_n, sum(o) / 16 - power(sum(sqrt(o)) / 16, 2) AS va, sum(n) / 16 - power(sum(sqrt(n)) / 16, 2) AS vb,
         sum(sqrt(o) * sqrt(n)) / 16 - sum(sqrt(o)) / 16 * sum(sqrt(n)) / 16 AS cov, max(abs(sqrt(o) - sqrt(n))) AS gap FROM pr GROUP BY 1, 2),
tm AS (SELECT series_id, quantile_cont(t_o, 0.5) FILTER (WHERE t_o > 0) AS mo, quantile_cont(t_n, 0.5) FILTER (WHERE t_n > 0) AS mn FROM bt GROUP BY 1),
rh AS (SELECT series_id, bar, CASE WHEN t_o > 0.2 * greatest(coalesce(mo, 0), 1e-12) AND t_n > 0.2 * greatest(coalesce(mn, 0), 1e-12)
     THEN CASE WHEN va > 1e-24 AND vb > 1e-24 THEN cov / sqrt(va * vb) WHEN gap <= 1e-8 THEN 1.0 ELSE 0.0 END
     WHEN (t_o > 0.2 * greatest(coalesce(mo, 0), 1e-12)) <> (t_n > 0.2 * greatest(coalesce(mn, 0), 1e-12)) THEN 0.0 END AS r FROM bt JOIN tm USING (series_id))"""


def powered(moved):
    p = lambda c: F.pow(F.lit(10.0), F.col(c) / 10).alias(c)
    return moved.select("series_id", "frame", p("old"), p("new"))


@query("rhythm_profile", f"WITH {RHYTHM} SELECT series_id, bar, slot, round(o, 6) AS energy FROM pr")
def rhythm_profile(spark, sf):
    pairs = versions(spark, sf)
    return L.rhythm_profile(powered(filled(pairs)), SERIES, "old", grids(pairs), 4, FPS).select(
        "series_id", "bar", "slot", F.round("energy", 6).alias("energy"))


@query("rhythm_changes", f"WITH {RHYTHM} SELECT series_id, bar, round(r, 6) AS r FROM rh")
def rhythm_changes(spark, sf):
    pairs = versions(spark, sf)
    return L.rhythm_changes(powered(filled(pairs)), grids(pairs), SERIES, 4, FPS).select(
        "series_id", "bar", F.round("r", 6).alias("r"))


BARS = LEVELS + "," + RHYTHM[len(ALIGNED) + 1:] + """,
ch AS (SELECT l.series_id, l.bar, round(l.delta, 3) AS d, round(l.r, 3) AS lr, h.r AS hr, f.v FROM lst l JOIN fresh f USING (series_id, bar) LEFT JOIN rh h USING (series_id, bar)),
fg AS (SELECT *, CASE WHEN d > 0.15 OR lr < 0.75 THEN greatest(d - 0.15, coalesce(0.75 - lr, 0.0)) END AS e1, CASE WHEN hr < 0.8 THEN 0.8 - hr END AS e2 FROM ch),
bars AS (SELECT series_id, bar, d AS delta, round(v, 3) AS new_voice, e1 IS NOT NULL OR e2 IS NOT NULL OR v > 0.1 AS changed,
   CASE WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN round(e2, 9) > round(e1, 9) THEN 'flux,rms' ELSE 'rms,flux' END WHEN e1 IS NOT NULL THEN 'rms' WHEN e2 IS NOT NULL THEN 'flux' ELSE '' END AS envelopes FROM fg)"""


def bars(pairs):
    moved = filled(pairs)
    grid, scale = grids(pairs), scaled(pairs, moved)
    levels = L.level_changes(scale, grid, SERIES, 1, FPS).withColumn("key", F.lit("rms")).withColumn("ord", F.lit(0))
    rhythm = L.rhythm_changes(powered(moved), grid, SERIES, 4, FPS).withColumn("key", F.lit("flux")).withColumn("ord", F.lit(1))
    return L.bar_changes(levels, rhythm, L.new_voice_share(scale, grid, SERIES, FPS), SERIES)


@query("bar_changes", f"WITH {BARS} SELECT * FROM bars")
def bar_changes(spark, sf):
    return bars(versions(spark, sf)).select("series_id", "bar", "delta", "new_voice", F.array_join("envelopes", ",").alias("envelopes"), "changed")


@query("verdict", f"WITH {BARS}," + CLASSIFY[len(VERSIONS) + 1:].replace(curve_sql("curve", "versions", SERIES, "old", "new", "vsize", REACH) + "," + best_sql("best", "curve", SERIES) + ",", "") + """,
au AS (SELECT series_id, min(frame) FILTER (WHERE old > po - 50) AS ho, min(frame) FILTER (WHERE new > pn - 50) AS hn
  FROM versions JOIN (SELECT series_id, max(old) AS po, max(new) AS pn FROM versions GROUP BY 1) USING (series_id) GROUP BY 1),
cb AS (SELECT series_id, count(*) FILTER (WHERE changed) AS changed_bars FROM bars GROUP BY 1),
vd AS (SELECT k.series_id, k.kind, k.off AS lag_s, coalesce(changed_bars, 0) AS changed_bars,
  CASE WHEN kind <> 'shift' OR (abs(off) > 1.0 / 48 AND (ho + off - hn > 0.25 OR ho + off < -0.25)) THEN 'new grid' WHEN changed_bars > 0 THEN 'rerender' WHEN abs(off) > 1.0 / 48 THEN 'offset' ELSE 'remux' END AS verdict
  FROM kinds k JOIN au USING (series_id) LEFT JOIN cb USING (series_id))
SELECT *, CASE verdict WHEN 'remux' THEN 0 WHEN 'rerender' THEN 3 WHEN 'new grid' THEN 4 ELSE 5 END AS exit_code, CASE WHEN verdict <> 'new grid' THEN round(lag_s, 4) END AS new_silent_start FROM vd""")
def verdict(spark, sf):
    pairs = versions(spark, sf)
    heads = [O.audible_span(pairs.where(F.col(c).isNotNull()), SERIES, c) for c in ("old", "new")]
    return L.verdict(kinds(pairs).withColumnRenamed("offset", "lag_s"), heads[0], heads[1], bars(pairs), SERIES, fps=FPS)


@query("band_shift", f"""WITH {BEST}, m AS (SELECT b.series_id, b.lag AS pos, b.r, CAST(least(greatest(b.series_id % 7 - 3, -{REACH}), {REACH}) AS BIGINT) AS mix FROM best b)
SELECT m.series_id, CASE WHEN m.r >= 0.8 AND m.r - c.r >= 0.2 AND pos <> mix THEN CAST(pos AS INTEGER) END AS lag, CASE WHEN m.r >= 0.8 AND m.r - c.r >= 0.2 AND pos <> mix THEN round(m.r, 2) END AS r
FROM m JOIN curve c ON c.series_id = m.series_id AND c.lag = m.mix""")
def band_shift(spark, sf):
    pairs = versions(spark, sf)
    own = pairs.select("series_id").distinct().withColumn("lag", F.col("series_id") % 7 - 3)
    return L.band_shift(pairs, own, SERIES, REACH)


@query("autocorrelation", f"""WITH {WEEKLY_FLUX}, m AS (SELECT series_id, avg(flux) AS mu FROM weekly_flux GROUP BY 1)
SELECT a.series_id, CAST(l.lag AS INTEGER) AS lag, round(sum((a.flux - mu) * (b.flux - mu)), 6) AS ac
FROM weekly_flux a JOIN m USING (series_id), range(3, 31) l(lag), weekly_flux b WHERE b.series_id = a.series_id AND b.frame = a.frame + l.lag GROUP BY 1, 2""")
def autocorrelation(spark, sf):
    from tidewheel.operators.grid import autocorrelation as ac

    return ac(settle(weekly_flux(spark, sf)), SERIES, "flux", 3, 30).select("series_id", "lag", F.round("ac", 6).alias("ac"))


@query("band_correlation", f"""WITH {WEEKLY}, bands AS (
  SELECT series_id, frame % 2 AS band, frame // 2 AS frame, value AS member, rmsdb AS master FROM weekly),
t AS (SELECT series_id, band, avg(member) AS mx, avg(master) AS my, sum(member) AS sx, var_pop(member) * count(*) AS vx, var_pop(master) * count(*) AS vy FROM bands GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN sqrt(vx) > 1e-9 AND sqrt(vy) > 1e-9 THEN sx ELSE 0 END AS w0 FROM t), w1 AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY series_id) AS share FROM w)
SELECT a.series_id, CAST(lag AS INTEGER) AS lag, round(sum(share * (a.member - mx) * (b.master - my) / sqrt(vx * vy)), 6) AS r
FROM bands a JOIN w1 USING (series_id, band), range(-6, 7) l(lag), bands b WHERE b.series_id = a.series_id AND b.band = a.band AND b.frame = a.frame + lag GROUP BY 1, 2""")
def band_correlation(spark, sf):
    bands = weekly_levels(spark, sf).select(
        "series_id", (F.col("frame") % 2).alias("band"), F.floor(F.col("frame") / 2).alias("frame"),
        F.col("value").alias("member"), F.col("rmsdb").alias("master"))
    return L.band_correlation(bands, SERIES, 6).select("series_id", "lag", F.round("r", 6).alias("r"))


@query("group_alignment")
def group_alignment(spark, sf):
    """Each supplier's return-flag parts lined up with its whole series, in groups of suppliers."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.col("l_returnflag").alias("stem"), "l_shipdate", "l_extendedprice")
    from tidewheel.plans.inputs import days

    stems = O.frame_grid(lines, ["series_id", "stem"], days() / F.lit(7.0) + F.col("series_id") % 3,
                         F.col("l_extendedprice") / 1000, 1.0).select("series_id", "stem", "frame", F.col("value").alias("member"))
    master = weekly(spark, sf).select("series_id", "frame", F.col("value").alias("master"))
    pairs = settle(stems.join(master, ["series_id", "frame"]).withColumn("band", F.lit(0)))
    return L.align_group(L.band_correlation(pairs, ["series_id", "stem"], 6), ["series_id"], "stem", fps=1.0)


def stretched(spark, sf, speed=1.02):
    """Each supplier's weekly values, smoothed over nine weeks; the new version of every other one plays `speed` times as fast."""
    frames = weekly(spark, sf).select("series_id", "frame", "value")
    old = settle(over_blocks(frames, SERIES, "frame", {"old": lambda w: 20 * F.avg("value").over(w.rowsBetween(-4, 4))}, 4, 4).select("series_id", "frame", "old"))
    rate = F.when(F.col("series_id") % 2 == 0, speed).otherwise(1.0)
    spans = old.groupBy("series_id").agg((F.floor((F.count("*") - 1) / F.first(rate)) + 1).cast("bigint").alias("_n"))
    spine = spread_index(spans, SERIES, "_n").withColumn("_pos", F.col("frame") * rate)
    new = sample_linear(spine, old, SERIES, "_pos", "old", "new").select("series_id", "frame", "new")
    return settle(join_keys(old, new, ["series_id", "frame"], "left"))


# The answer is known from how the input is made: the slower version's every second series, at the speed of the other.
@query("tempo_change", "SELECT DISTINCT l_suppkey AS series_id, 1.02 AS ratio, 0.0 AS lag_s FROM lineitem WHERE l_suppkey % 2 = 0")
def tempo_change(spark, sf):
    """Suppliers whose new series reads as the old one at another speed."""
    pairs = stretched(spark, sf)
    return L.tempo_change(pairs, windows(pairs), SERIES, FPS, reach_s=6.0).select(
        "series_id", F.round("ratio", 2).alias("ratio"), (F.round("lag_s", 0) + 0.0).alias("lag_s"))


@query("full_span", f"WITH {VERSIONS} SELECT series_id, frame, round(coalesce(old, -100.0), 6) AS old, round(coalesce(new, -100.0), 6) AS new FROM versions")
def full_span_query(spark, sf):
    return versions(spark, sf).fillna(-100.0, subset=["old", "new"]).select(
        "series_id", "frame", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"))


@query("lined_up", f"""WITH {WEEKLY}, s AS (SELECT DISTINCT series_id, unnest(range(0, 300)) AS frame FROM weekly)
SELECT s.series_id, s.frame, round(coalesce(w.value, 0.0), 6) AS value FROM s LEFT JOIN weekly w ON w.series_id = s.series_id AND w.frame = s.frame - (s.series_id % 9 - 4)""")
def lined_up_query(spark, sf):
    frames = weekly(spark, sf)
    lags = frames.select("series_id").distinct().select(
        "series_id", (F.col("series_id") % 9 - 4).alias("lag"), F.lit(300).cast("bigint").alias("length"))
    return lined_up(frames, lags, SERIES, "value").select("series_id", "frame", F.round("value", 6).alias("value"))
