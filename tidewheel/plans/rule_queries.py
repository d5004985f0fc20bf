"""Queries over rules, specifications, texts and packs."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidewheel.functions import platform_specs as P
from tidewheel.functions import scalar as S
from tidewheel.functions import text as X
from tidewheel.operators import rules as R
from tidewheel.operators.aggregates import mood_line
from tidewheel.plans.event_queries import CUTS, FPS, songs
from tidewheel.plans.inputs import SERIES, WEEKLY, weekly_levels
from tidewheel.session import settle, shared_path, spread, table
from tidewheel.sources import packs as K

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


LINE = ["l_orderkey", "l_linenumber"]


@query("row_validation", """WITH s AS (SELECT o_orderkey, o_totalprice / 1000 AS s, o_totalprice / 1000 + (o_custkey % 11) - 2 AS e, CASE o_orderstatus WHEN 'P' THEN 'every_3_beats' ELSE 'every_beat' END AS d, CASE WHEN o_orderkey % 4 = 0 THEN 'sepia' ELSE 'grain' END AS fx FROM orders)
SELECT o_orderkey, 'end after start' AS rule, 'refuse' AS level FROM s WHERE e <= s UNION ALL SELECT o_orderkey, 'known density', 'refuse' FROM s WHERE d <> 'every_beat' UNION ALL SELECT o_orderkey, 'known effects', 'refuse' FROM s WHERE fx = 'sepia'""")
def row_validation(spark, sf):
    s = F.col("o_totalprice") / 1000
    rows = table(spark, sf, "orders").select(
        "o_orderkey", s.alias("start"), (s + F.col("o_custkey") % 11 - 2).alias("end"),
        F.when(F.col("o_orderstatus") == "P", "every_3_beats").otherwise("every_beat").alias("cut_density"),
        F.array(F.when(F.col("o_orderkey") % 4 == 0, "sepia").otherwise("grain")).alias("effects"))
    return R.validate(rows, ["o_orderkey"], R.section_rules()).select("o_orderkey", "rule", "level")


@query("look_validation", """WITH p AS (SELECT p_partkey, p_size / 25.0 - 1.1 AS t, p_size / 24.0 AS s, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '#1a0f06' END AS sh, CASE WHEN p_partkey % 7 = 0 THEN '#12345' WHEN p_partkey % 11 = 0 THEN NULL ELSE '#ffcc00' END AS hi FROM part)
SELECT p_partkey, 'temperature -1..1' AS rule FROM p WHERE t < -1 OR t > 1 UNION ALL SELECT p_partkey, 'saturation 0..2' FROM p WHERE s < 0 OR s > 2 UNION ALL SELECT p_partkey, 'duotone pair' FROM p WHERE (sh IS NULL) <> (hi IS NULL) UNION ALL SELECT p_partkey, 'duotone colours' FROM p WHERE hi = '#12345'""")
def look_validation(spark, sf):
    k = F.col("p_partkey")
    looks = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 25.0 - 1.1).alias("temperature"), (F.col("p_size") / 24.0).alias("saturation"),
                                            F.when(k % 5 != 0, "#1a0f06").alias("shadow"),
                                            F.when(k % 7 == 0, "#12345").when(k % 11 != 0, "#ffcc00").alias("highlight"))
    return R.validate(looks, ["p_partkey"], R.look_rules()).select("p_partkey", "rule")


@query("contiguity", f"""WITH {CUTS}, ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s, e) - 1 AS idx FROM cuts),
b AS (SELECT series_id, idx, s + CASE WHEN idx % 17 = 3 THEN 0.5 WHEN idx % 29 = 4 THEN -0.5 ELSE 0 END AS s, e FROM ix), l AS (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY idx) AS p FROM b)
SELECT series_id, idx, CASE WHEN p IS NULL THEN 'late start' WHEN s < p THEN 'overlap' ELSE 'gap' END AS rule FROM l WHERE (p IS NULL AND s > 1e-6) OR s < p - 1e-6 OR s > p + 1e-6""")
def contiguity(spark, sf):
    from tidewheel.operators.blocks import number_rows
    from tidewheel.operators.edit import cut_boundaries

    sections, beats, _, _ = songs(spark, sf)
    cuts = settle(cut_boundaries(sections, beats, SERIES, FPS))
    indexed = number_rows(cuts, SERIES, ["start", "end"], F.floor(F.col("start") / 3600).cast("bigint"), "n").withColumn("idx", F.col("n") - 1)
    moved = F.when(F.col("idx") % 17 == 3, 0.5).when(F.col("idx") % 29 == 4, -0.5).otherwise(0.0)
    return R.contiguity(indexed.withColumn("start", F.col("start") + moved), SERIES, "idx", "start", "end")


@query("timeline_problems", """WITH p AS (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) * 512 + CASE WHEN l_orderkey % 9973 = 7 THEN 512 WHEN l_orderkey % 9973 = 8 THEN 100 ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN 512 ELSE 0 END AS pts FROM lineitem),
o AS (SELECT *, row_number() OVER w AS n, lag(pts) OVER w AS q FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY pts)),
b AS (SELECT l_suppkey, n - 2 AS place, CASE WHEN pts - q > 512 THEN 'gap' WHEN pts = q THEN 'repeat' ELSE 'too close' END AS k FROM o WHERE q IS NOT NULL AND pts - q <> 512),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY place) = 1), c AS (SELECT l_suppkey, count(*) AS n, min(pts) AS m FROM p GROUP BY 1)
SELECT l_suppkey, k AS rule, place FROM f UNION ALL SELECT l_suppkey, 'count', NULL FROM c WHERE n <> 600 UNION ALL SELECT l_suppkey, 'first', NULL FROM c WHERE m <> 0""")
def timeline_problems(spark, sf):
    from tidewheel.operators.blocks import number_rows

    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    numbered = number_rows(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber"], F.floor(F.col("l_orderkey") / 65536).cast("bigint"), "n")
    k = F.col("l_orderkey") % 9973
    pts = (F.col("n") - 1) * 512 + F.when(k == 7, 512).when(k == 8, 100).otherwise(0) + F.when(F.col("l_suppkey") % 7 == 0, 512).otherwise(0)
    points = settle(numbered.select("l_suppkey", pts.alias("pts")))
    expected = points.select("l_suppkey").distinct().withColumn("frames", F.lit(600))
    return R.timeline_problems(points, expected, ["l_suppkey"], "pts", "frames", 512.0).withColumnRenamed("at", "place")


_ids = [r[0] for r in P.rows()]


def _artifact_sql():
    names = ", ".join(f"'{i}'" for i in _ids)
    return f"""art AS (SELECT l_orderkey, l_linenumber, [{names}][1 + (l_orderkey * 7 + l_linenumber) % 20] AS platform,
  CASE WHEN l_quantity > 48 THEN NULL ELSE [1080, 720, 3000, 1920, 640][1 + l_partkey % 5] END AS width, [1920, 1280, 3000, 1080, 640][1 + l_suppkey % 5] AS height,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE [24, 25, 29.97, 30, 61][1 + l_orderkey % 5] END AS fps, CAST(l_quantity * l_quantity AS DOUBLE) AS seconds, l_returnflag <> 'N' AS has_audio,
  l_extendedprice / 1000 AS file_mb, CASE WHEN l_linestatus = 'F' THEN -14 + l_tax * 10 END AS lufs FROM lineitem)"""


def _spec_sql():
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return f"CAST({v} AS DOUBLE)"
        return "'" + str(v) + "'"

    use = [c for c in P.COLUMNS if c not in ("aliases", "sizes", "fps_allowed", "fps_common")]
    rows = []
    for r in P.rows():
        d = dict(zip(P.COLUMNS, r))
        sizes = [(d["width"], d["height"]), *d["sizes"]]
        lists = [f"[{', '.join(f'{w * 100000 + h}' for w, h in sizes)}]", *[
            f"CAST([{', '.join(str(x) for x in d[c])}] AS DOUBLE[])" for c in ("fps_allowed", "fps_common")]]
        rows.append("(" + ", ".join([cell(d[c]) for c in use] + lists) + ")")
    cols = [("s_" + c if c in ("width", "height", "lufs", "audio") else c) for c in use] + ["sizes", "fps_allowed", "fps_common"]
    return f"spec({', '.join(cols)}) AS (VALUES {', '.join(rows)})"


SPEC_FINDINGS = f"""{_artifact_sql()}, {_spec_sql()},
j AS (SELECT *, kind = 'video' AS video, width IS NOT NULL AND height IS NOT NULL AND NOT list_contains(sizes, width * 100000 + height) AS known,
   list_filter(sizes, lambda s: abs(width * (s % 100000) - height * (s // 100000)) <= 0.01 * height * (s // 100000)) AS alike FROM art JOIN spec USING (platform)),
k AS (SELECT *, coalesce(width < min_width, FALSE) OR coalesce(height < min_height, FALSE) OR coalesce(width > max_width, FALSE) OR coalesce(height > max_height, FALSE) AS broken,
   len(alike) > 0 AS shaped, (alike[1] // 100000) * (alike[1] % 100000) AS want, width * height AS area, file_mb * 8 / nullif(seconds, 0) AS mbps FROM j),
f AS (
 SELECT l_orderkey, l_linenumber, platform, 'size' AS rule, CASE WHEN known AND broken THEN 'refuse' WHEN known AND shaped AND area < want AND min_width IS NULL AND min_height IS NULL THEN 'warn' WHEN known AND shaped AND area > want AND max_width IS NULL AND max_height IS NULL THEN 'info' END AS level FROM k
 UNION ALL SELECT l_orderkey, l_linenumber, platform, 'aspect', CASE WHEN known AND NOT shaped THEN CASE WHEN aspect_fixed THEN 'refuse' ELSE 'warn' END END FROM k
 UNION ALL SELECT l_orderkey, l_linenumber, platform, 'length', CASE WHEN video THEN CASE WHEN seconds < min_seconds - 1e-3 OR seconds > max_seconds + 1e-3 THEN 'refuse' WHEN seconds > soft_seconds + 1e-3 THEN 'warn' END END FROM k
 UNION ALL SELECT l_orderkey, l_linenumber, platform, 'frame rate', CASE WHEN video AND fps IS NOT NULL THEN CASE WHEN fps < fps_low - 0.01 OR fps > fps_high + 0.01 THEN 'refuse' WHEN len(fps_allowed) > 0 AND len(list_filter(fps_allowed, lambda r: abs(fps - r) < 0.01)) = 0 THEN 'refuse' WHEN len(fps_common) > 0 AND len(list_filter(fps_common, lambda r: abs(fps - r) < 0.01)) = 0 THEN 'info' END END FROM k
 UNION ALL SELECT l_orderkey, l_linenumber, platform, 'audio', CASE WHEN video AND has_audio AND s_audio = 'none' THEN 'refuse' END FROM k
 UNION ALL SELECT l_orderkey, l_linenumber, platform, 'file size', CASE WHEN file_mb > max_mb THEN 'refuse' WHEN file_mb > soft_mb THEN 'warn' END FROM k
 UNION ALL SELECT l_orderkey, l_linenumber, platform, 'bitrate', CASE WHEN video THEN CASE WHEN mbps > max_mbps OR mbps < min_mbps THEN 'warn' END END FROM k
 UNION ALL SELECT l_orderkey, l_linenumber, platform, 'loudness', CASE WHEN video AND has_audio AND lufs IS NOT NULL AND s_lufs IS NOT NULL THEN 'info' END FROM k),
found AS (SELECT * FROM f WHERE level IS NOT NULL)"""


def artifacts(spark, sf):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + k).cast("int"))
    c = F.col
    return spread(table(spark, sf, "lineitem")).select(
        *LINE, pick(_ids, (c("l_orderkey") * 7 + c("l_linenumber")) % 20).alias("platform"),
        F.when(c("l_quantity") <= 48, pick((1080, 720, 3000, 1920, 640), c("l_partkey") % 5)).alias("width"),
        pick((1920, 1280, 3000, 1080, 640), c("l_suppkey") % 5).alias("height"),
        F.when(c("l_linenumber") != 7, pick((24.0, 25.0, 29.97, 30.0, 61.0), c("l_orderkey") % 5)).alias("fps"),
        (c("l_quantity") * c("l_quantity")).alias("seconds"), (c("l_returnflag") != "N").alias("has_audio"),
        (c("l_extendedprice") / 1000).alias("file_mb"), F.when(c("l_linestatus") == "F", -14 + c("l_tax") * 10).alias("lufs"))


@query("spec_findings", f"WITH {SPEC_FINDINGS} SELECT * FROM found")
def spec_findings(spark, sf):
    return R.platform_findings(artifacts(spark, sf), LINE).select(*LINE, "platform", "rule", "level")


# What is measured replaces what is planned: sound always, sizes and frame rates on every second line.
@query("planned_vs_measured", f"""WITH {SPEC_FINDINGS}
SELECT *, CASE WHEN rule = 'audio' OR (l_linenumber % 2 = 0 AND rule IN ('size', 'aspect', 'frame rate')) THEN 'measured' ELSE 'planned' END AS source FROM found""")
def planned_vs_measured(spark, sf):
    planned = artifacts(spark, sf)
    full = F.col("l_linenumber") % 2 == 0
    none = F.lit(None)
    measured = planned.select(*LINE, "platform", *[F.when(full, F.col(c)).alias(c) for c in ("width", "height", "fps")],
                              none.cast("double").alias("seconds"), "has_audio", none.cast("double").alias("file_mb"), none.cast("double").alias("lufs"))
    of = lambda df, name: R.platform_findings(df, LINE).select(*LINE, "platform", "rule", "level", F.lit(name).alias("source"))
    return R.merge_measured(of(planned, "planned"), of(measured, "measured"), R.known_rules(measured, LINE), LINE)


@query("duplicate_outputs", "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_outputs(spark, sf):
    return R.duplicates(table(spark, sf, "lineitem"), LINE)


@query("gain_plan", """WITH m AS (SELECT o_orderkey, -8 - (o_totalprice % 977) / 71.3 AS lufs, (o_custkey % 9) * 0.5 - 2 AS tp, ['loudness', 'fixed', 'auto'][1 + o_orderkey % 3] AS mode, CASE WHEN o_orderkey % 4 = 0 THEN -1.5 END AS c FROM orders),
p AS (SELECT *, CASE WHEN mode = 'loudness' THEN round(-11.3 - lufs, 2) ELSE -0.5 END AS g, CASE WHEN mode = 'loudness' THEN -11.3 ELSE lufs - 0.5 END AS pl FROM m)
SELECT o_orderkey, g AS start_gain, round(pl, 6) AS planned_lufs, CAST(coalesce(c, CASE WHEN pl > -14 THEN -2 ELSE -1 END) AS DOUBLE) AS ceiling_dbtp,
 concat_ws('; ', CASE WHEN mode <> 'loudness' AND tp > 0 THEN 'pre-master peak over 0' END, CASE WHEN c IS NOT NULL AND pl > -14 AND c > -2 THEN 'ceiling over -2 for a loud delivery' END) AS warnings FROM p""")
def gain_plan(spark, sf):
    k = F.col("o_orderkey")
    masters = table(spark, sf, "orders").select(
        "o_orderkey", (-8 - (F.col("o_totalprice") % 977) / 71.3).alias("lufs"), ((F.col("o_custkey") % 9) * 0.5 - 2).alias("true_peak"),
        F.element_at(F.array(F.lit("loudness"), F.lit("fixed"), F.lit("auto")), (1 + k % 3).cast("int")).alias("mode"),
        F.lit(-11.3).alias("target_lufs"), F.lit(-0.5).alias("gain_db"), F.when(k % 4 == 0, -1.5).alias("ceiling"))
    return R.gain_plan(masters, ["o_orderkey"]).withColumn("planned_lufs", F.round("planned_lufs", 6))


@query("next_setting", """WITH r AS (SELECT l_orderkey, max(l_discount * 37 - 1.37) AS w FROM lineitem GROUP BY 1), s AS (SELECT *, ['loudness', 'fixed', 'auto'][1 + l_orderkey % 3] AS mode, CAST(l_orderkey % 7 AS INTEGER) AS used FROM r),
n AS (SELECT *, least(6 - used, 6, greatest(1, ceil((w + 1) / 0.5 - 1e-9))) AS n, mode = 'fixed' OR 6 - used <= 0 AS stuck FROM s)
SELECT l_orderkey, round(w, 6) AS worst_peak, CASE WHEN NOT stuck THEN CASE WHEN mode = 'loudness' THEN -1.0 ELSE round(-1.0 - n * 0.5, 2) END END AS gain_db, CASE WHEN NOT stuck AND mode = 'loudness' THEN greatest(round(-2.0 - n * 0.5, 2), -24.0) END AS limiter_dbfs,
 CAST(CASE WHEN stuck THEN used ELSE used + n END AS INTEGER) AS used FROM n""")
def next_setting(spark, sf):
    rounds = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_discount") * 37 - 1.37).alias("true_peak"))
    k = F.col("l_orderkey")
    settings = rounds.select("l_orderkey").distinct().select(
        "l_orderkey", F.element_at(F.array(F.lit("loudness"), F.lit("fixed"), F.lit("auto")), (1 + k % 3).cast("int")).alias("mode"),
        F.lit(-1.0).alias("gain_db"), F.lit(-2.0).alias("limiter_dbfs"), F.lit(-1.0).alias("ceiling"), F.lit(0.5).alias("step_db"),
        F.lit(6).alias("max_steps"), (k % 7).cast("int").alias("used"))
    return R.next_setting(rounds, settings, ["l_orderkey"]).withColumn("worst_peak", F.round("worst_peak", 6))


@query("edge_levels", f"""WITH {WEEKLY}, c AS (SELECT DISTINCT series_id, k AS cut, k * 40.0 AS s, k * 40.0 + 38.0 AS e, k % 2 AS fi, series_id % 2 AS fo FROM (SELECT series_id, unnest(range(0, CAST(max(frame) AS BIGINT) // 40 + 1)) AS k FROM weekly GROUP BY series_id)),
ed AS (SELECT series_id, cut, 'start' AS edge, s AS a FROM c WHERE fi = 0 UNION ALL SELECT series_id, cut, 'end', e - 2.0 FROM c WHERE fo = 0)
SELECT ed.series_id, cut, edge, round(max(rmsdb - 3.0), 6) AS level FROM ed JOIN weekly w ON w.series_id = ed.series_id AND t >= a AND t < a + 2.0 GROUP BY 1, 2, 3 HAVING max(rmsdb - 3.0) > -60""")
def edge_levels(spark, sf):
    levels = weekly_levels(spark, sf)
    ends = levels.groupBy("series_id").agg(F.floor(F.max("frame") / 40).cast("bigint").alias("last"))
    cuts = ends.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).select(
        "series_id", "cut", (F.col("cut") * 40.0).alias("start"), (F.col("cut") * 40.0 + 38.0).alias("end"),
        (F.col("cut") % 2).alias("fade_in"), (F.col("series_id") % 2).alias("fade_out"), F.lit(-3.0).alias("gain_db"))
    return R.edge_levels(levels, cuts, SERIES, "t", "rmsdb", width=2.0).withColumn("level", F.round("level", 6))


@query("reframe_plan", """WITH x AS (SELECT p_partkey, [1080, 720, 608, 1920, 1000][1 + p_partkey % 5] AS w, [1920, 1280, 1080, 1080, 1000][1 + p_size % 5] AS h, CASE WHEN p_partkey % 3 = 0 THEN 'pad-blur' WHEN p_partkey % 3 = 1 THEN 'crop' END AS how FROM part),
y AS (SELECT *, (w = 1080 AND h = 1920) OR (w = 1080 AND h = 1080) AS exact, abs(w * 1920 - h * 1080) <= 0.01 * h * 1080 AS tall, abs(w * 1080 - h * 1080) <= 0.01 * h * 1080 AS square FROM x),
z AS (SELECT *, CASE WHEN exact THEN 'copy' WHEN tall OR square THEN 'scale' ELSE coalesce(how, 'crop') END AS method FROM y)
SELECT p_partkey, method, CAST(CASE WHEN exact THEN w ELSE 1080 END AS INTEGER) AS target_w, CAST(CASE WHEN exact THEN h WHEN tall THEN 1920 WHEN square THEN 1080 ELSE 1920 END AS INTEGER) AS target_h,
 round(CASE WHEN method = 'copy' THEN w WHEN method = 'scale' THEN 1080 WHEN method = 'crop' THEN CASE WHEN w * 1920 >= h * 1080 THEN greatest(1080, 2 * ceil(1920.0 * w / h / 2 - 1e-9)) ELSE 1080 END ELSE CASE WHEN w * 1920 >= h * 1080 THEN 1080 ELSE least(1080, 2 * round_even(1920.0 * w / h / 2, 0)) END END / CAST(w AS DOUBLE), 6) AS enlarged FROM z""")
def reframe_plan(spark, sf):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + k).cast("int"))
    k = F.col("p_partkey")
    size = lambda w, h: F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"))
    pictures = table(spark, sf, "part").select(
        "p_partkey", pick((1080, 720, 608, 1920, 1000), k % 5).alias("width"), pick((1920, 1280, 1080, 1080, 1000), F.col("p_size") % 5).alias("height"),
        F.array(size(1080, 1920), size(1080, 1080)).alias("sizes"), F.when(k % 3 == 0, "pad-blur").when(k % 3 == 1, "crop").alias("how"))
    return R.reframe_plan(pictures, ["p_partkey"], "sizes", "how").withColumn("enlarged", F.round("enlarged", 6))


@query("manifest_problems", """WITH m AS (SELECT o_orderkey, 24.0 AS fps, CASE WHEN o_orderkey % 10 = 0 THEN 25.0 ELSE 24.0 END AS mf, (o_custkey % 50) * 1.0 AS t0, (o_custkey % 50) + CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 0.01 END AS mt, 20.0 AS dur, CASE WHEN o_orderkey % 9 = 0 THEN 21.0 ELSE 20.0 END AS md, (o_custkey % 50) + 12.0 + CASE WHEN o_orderkey % 13 = 0 THEN 40 ELSE 0 END AS jn, 288 - o_orderkey % 3 AS body FROM orders),
k AS (SELECT *, jn > mt AND jn < mt + md AS ins FROM m)
SELECT o_orderkey, 'rate' AS rule FROM k WHERE mf <> fps UNION ALL SELECT o_orderkey, 'start' FROM k WHERE mf = fps AND abs(mt - t0) > 0.5 / 24 UNION ALL SELECT o_orderkey, 'length' FROM k WHERE mf = fps AND abs(md - dur) > 0.5 / 24 UNION ALL SELECT o_orderkey, 'join' FROM k WHERE mf = fps AND NOT ins
UNION ALL SELECT o_orderkey, 'body' FROM k WHERE mf = fps AND ins AND body <> round_even((jn - mt) * 24, 0) UNION ALL SELECT o_orderkey, 'ending' FROM k WHERE mf = fps AND (body + 192 <> 480 OR body + 193 <> 480)""")
def manifest_problems(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    o = table(spark, sf, "orders")
    cuts = o.select("o_orderkey", F.lit(24.0).alias("fps"), (c * 1.0).alias("t0"), F.lit(20.0).alias("dur"))
    manifests = o.select("o_orderkey", F.when(k % 10 == 0, 25.0).otherwise(24.0).alias("m_fps"), (c + F.when(k % 7 == 0, 0.5).otherwise(0.01)).alias("m_t0"),
                         F.when(k % 9 == 0, 21.0).otherwise(20.0).alias("m_dur"), (c + 12.0 + F.when(k % 13 == 0, 40).otherwise(0)).alias("at"),
                         (288 - k % 3).alias("body"), F.array(F.lit(192), F.lit(193)).alias("endings"))
    return R.manifest_problems(cuts, manifests, ["o_orderkey"]).select("o_orderkey", "rule")


@query("first_difference", """WITH a AS (SELECT l_orderkey, l_linenumber AS ord, 'p' || l_linenumber AS name, l_shipdate < TIMESTAMP '1998-06-01' AS v FROM lineitem), d AS (SELECT DISTINCT ON (l_orderkey, ord) * FROM a ORDER BY l_orderkey, ord, v),
b AS (SELECT l_orderkey, ord, name, CASE WHEN l_orderkey % 3 = 0 THEN v ELSE NOT v END AS v FROM d WHERE ord <> 3),
x AS (SELECT coalesce(d.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(d.ord, b.ord) AS ord, coalesce(d.name, b.name) AS name, CAST(d.v AS VARCHAR) AS a, CAST(b.v AS VARCHAR) AS b FROM d FULL JOIN b ON d.l_orderkey = b.l_orderkey AND d.name = b.name)
SELECT l_orderkey, name, a, b FROM x WHERE a IS DISTINCT FROM b QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) = 1""")
def first_difference(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("ord")).agg(
        F.min(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")).alias("v")).select(
        "l_orderkey", "ord", F.concat(F.lit("p"), "ord").alias("name"), "v")
    b = a.where("ord <> 3").withColumn("v", F.when(F.col("l_orderkey") % 3 == 0, F.col("v")).otherwise(~F.col("v")))
    text = lambda df: df.withColumn("v", F.col("v").cast("string"))
    return R.first_difference(text(a), text(b), ["l_orderkey"], "name", "v", "ord")


# ---- texts
_MARKED = "CASE WHEN doc_id % 5 = 0 THEN text || ' #tag' WHEN doc_id % 7 = 0 THEN text || ' see https://x.example' WHEN doc_id % 11 = 0 THEN text || ' wow!' ELSE text END"


def documents(spark, sf):
    k = F.col("doc_id")
    marked = (F.when(k % 5 == 0, F.concat("text", F.lit(" #tag"))).when(k % 7 == 0, F.concat("text", F.lit(" see https://x.example")))
              .when(k % 11 == 0, F.concat("text", F.lit(" wow!"))).otherwise(F.col("text")))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", marked.alias("text"))


@query("rule_breaks", f"""WITH d AS (SELECT doc_id, {_MARKED} AS t FROM documents)
SELECT doc_id, concat_ws(', ', CASE WHEN regexp_matches(t, '[\U0001f000-\U0001faff⌀-⏿☀-➿⬀-⯿️]') THEN 'an emoji' END, CASE WHEN regexp_matches(t, '[#＃]') THEN 'a #' END, CASE WHEN regexp_matches(t, '[@＠]') THEN 'an @' END, CASE WHEN regexp_matches(t, '[!¡！]') THEN 'an exclamation mark' END,
 CASE WHEN regexp_matches(t, '(?i)https?://|\\bwww\\.|\\b[\\w-]+\\.(?:com|net|org|io|fm|me|ly|ee|link|app|co|to|be|tv)\\b') THEN 'a link' END) AS breaks FROM d""")
def rule_breaks(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(X.rule_breaks(F.col("text")), ", ").alias("breaks"))


_RAW = "conv_id || ' at /srv/media/take ' || role || '.wav and C:\\\\x then ' || role || ' ~/notes ' || turn"


@query("scrub_text", r"""WITH w AS (SELECT conv_id, turn, 'saw /srv/media/take' || turn || ' and ' || role || '.wav then a/b/c ~/notes C:\x ' || text AS m FROM conversations),
p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(m, '\s+'), lambda w: w <> '') AS ws FROM w)
SELECT conv_id, turn, replace(left(array_to_string(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '(?:^|[^\w.-])/[^/\s]+/|^/[^/\s]+$|^~/|\\|^[A-Za-z]:[\\/]|[^\s/]+/[^\s/]+/') THEN '<path>' WHEN regexp_matches(w, '(?i)[^\s/\\]+\.(?:wav|aiff?|flac|mp3|m4a|ogg|opus|mp4|m4v|mov|mkv|webm|jpe?g|png|tiff?|heic|json|ya?ml)\b') THEN '<file>' ELSE w END), ' '), 300), '~~', '~~') AS message FROM p""")
def scrub_text(spark, sf):
    message = F.concat(F.lit("saw /srv/media/take"), "turn", F.lit(" and "), "role", F.lit(".wav then a/b/c ~/notes C:\\x "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.scrub(message).alias("message"))


@query("alias_lookup", "WITH a(k, platform) AS (VALUES " + ", ".join(
    f"('{k}', '{i}')" for k, i in P.alias_rows()) +
    "), n AS (SELECT l_orderkey, l_linenumber, [' YT', 'ig-reel', 'TikTok ', 'canvas', 'nowhere'][1 + l_orderkey % 5] AS name FROM lineitem) SELECT l_orderkey, l_linenumber, name, platform FROM n LEFT JOIN a ON a.k = lower(trim(name))")
def alias_lookup(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in (" YT", "ig-reel", "TikTok ", "canvas", "nowhere")]), (1 + F.col("l_orderkey") % 5).cast("int"))
    lines = table(spark, sf, "lineitem").select(*LINE, name.alias("name"))
    return X.resolve_alias(lines, F.broadcast(P.aliases(spark)), "name", "alias", "platform").select(*LINE, "name", "platform")


@query("log_measurements", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN CAST('-inf' AS DOUBLE) ELSE round(-8 - l_quantity / 4, 2) END AS lufs, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_tax END AS peak,
 CASE WHEN l_linenumber > 5 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS input_i, l_quantity AS fps FROM lineitem""")
def log_measurements(spark, sf):
    c = F.col
    level = F.when(c("l_linenumber") == 3, "-inf").otherwise(S.round_places(-8 - c("l_quantity") / 4, 2).cast("string"))
    # A line whose value is missing is missing in the log.
    line = lambda *parts: F.coalesce(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), F.lit(""))
    log = F.concat(F.lit("Summary:\n  I: -1.0 LUFS\n running I: -70.0 LUFS\n{\"input_i\": \"0\"}\n{\"other\": 1}\n"),
                   F.when(c("l_linenumber") > 5, "{\"output\": 2}\n").otherwise(line("{\"input_i\": \"", c("l_orderkey"), "\"}\n")),
                   F.lit("Summary:\n  Integrated loudness:\n"), line("    I:   ", level, " LUFS\n"),
                   F.when(c("l_linenumber") == 4, "").otherwise(line("    Peak:   ", c("l_tax"), " dBFS\n")),
                   line("DONE 100 frames in 12s (", c("l_quantity"), " fps)\n"))
    logs = table(spark, sf, "lineitem").select(*LINE, log.alias("log"))
    lufs, peak = X.loudness_of(F.col("log"))
    block = F.get_json_object(X.last_json(F.col("log"), "input_i"), "$.input_i")
    return logs.select(*LINE, lufs.alias("lufs"), peak.alias("peak"),
                       F.when((c("l_linenumber") > 5) | c("l_orderkey").isNull(), None).otherwise(block).alias("input_i"), X.done_rate(F.col("log")).alias("fps"))


@query("persian_text", f"""SELECT doc_id, regexp_replace(translate('كتاب يك ' || text, '{X.ARABIC}', '{X.PERSIAN}'), '({X.LATIN_RUN.replace("'", "''")})', '{X.ISOLATE}\\1{X.POP}', 'g') AS text FROM documents""")
def persian_text(spark, sf):
    """Every document with Arabic letters folded and Latin runs isolated, names kept."""
    arabic = F.concat(F.lit("كتاب يك "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.persian(arabic, ("يك Band",)).alias("text"))


@query("slug_unique", """WITH s AS (SELECT p_partkey, p_brand, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part)
SELECT p_partkey, p_brand, slug, CASE WHEN row_number() OVER w = 1 THEN slug ELSE slug || '-' || row_number() OVER w END AS "unique" FROM s WINDOW w AS (PARTITION BY p_brand, slug ORDER BY p_partkey)""")
def slug_unique(spark, sf):
    """Every part's whole name as a unique key within its brand."""
    keyed = settle(table(spark, sf, "part").select("p_partkey", "p_brand", X.slug(F.col("p_name")).alias("slug")))
    return X.unique_suffixes(keyed, ["p_brand"], "slug", "p_partkey", "unique").select("p_partkey", "p_brand", "slug", "unique")


def _leak_sql() -> str:
    """SQL twin: the document's leaves are known; RE2's classes are spelled for all scripts."""
    wide = lambda p: p.replace("(?U)", "").replace("[^\\w.-]", "[^\\p{L}\\p{M}\\p{N}_.-]").replace("'", "''")
    return f"""WITH leaf AS (SELECT page_id, '$.url' AS path, url AS v FROM pages UNION ALL SELECT page_id, '$.body.html', html FROM pages
  UNION ALL SELECT page_id, '$.body.links[0]', url FROM pages),
t AS (SELECT *, regexp_matches(v, '{wide(X.PATHLIKE)}') AS p, regexp_matches(v, '{wide(X.FILENAME)}') AS f FROM leaf)
SELECT page_id, path, 'looks like a path' AS reason FROM t WHERE p UNION ALL SELECT page_id, path, 'names a file' FROM t WHERE f AND NOT p
UNION ALL SELECT page_id, path, 'holds private token #1' FROM t WHERE contains(lower(v), 'example')"""


@query("leak_scan", _leak_sql())
def leak_scan(spark, sf):
    """Paths, file names and private tokens in pages' addresses and bodies, as nested documents."""
    pages = table(spark, sf, "pages").select("page_id", F.to_json(F.struct("url", F.struct("html", F.array(F.col("url")).alias("links")).alias("body"))).alias("doc"))
    return X.leaks(pages, ["page_id"], "doc", ("example",))


_KNOWN = sorted({name for name, _ in P.alias_rows()})


@query("did_you_mean", f"""WITH k AS (SELECT unnest([{", ".join(f"'{n}'" for n in _KNOWN)}]) AS c), a AS (SELECT list(c ORDER BY c) AS l FROM k),
w AS (SELECT DISTINCT left(n, p) || substr(n, p + 2) AS word FROM (SELECT l[1 + o_orderkey % len(l)] AS n, CAST(o_custkey % length(l[1 + o_orderkey % len(l)]) AS INTEGER) AS p FROM orders, a)),
s AS (SELECT word, c, round(1.0 - levenshtein(word, c) / CAST(greatest(length(word), length(c)) AS DOUBLE), 9) AS s FROM w, k),
t AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, c) AS r FROM s WHERE s >= 0.6)
SELECT word, string_agg(c, ',' ORDER BY r) AS closest FROM t WHERE r <= 2 GROUP BY word""")
def did_you_mean(spark, sf):
    """Platform names and aliases with one letter lost, as orders choose it, against the names themselves."""
    known = F.array(*[F.lit(n) for n in _KNOWN])
    picked = table(spark, sf, "orders").select(F.element_at(known, (F.col("o_orderkey") % len(_KNOWN) + 1).cast("int")).alias("n"), "o_custkey")
    at = (F.col("o_custkey") % F.length("n")).cast("int")
    words = picked.select(F.concat(F.left("n", at), F.substring(F.col("n"), at + 2, F.length("n"))).alias("word"))
    return X.closest(words, P.aliases(spark), "word", "alias").where(F.size("closest") > 0).select(
        "word", F.array_join("closest", ",").alias("closest"))


@query("release_notes", """WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) / 10000 AS dur FROM orders GROUP BY 1), s AS (SELECT o_custkey, string_agg('- ' || CAST(o_orderkey % 60 AS BIGINT) || ':00 ' || o_orderpriority, chr(10) ORDER BY (o_orderkey % 60) * 60, '- ' || CAST(o_orderkey % 60 AS BIGINT) || ':00 ' || o_orderpriority) AS ch FROM orders GROUP BY 1),
m AS (SELECT o_custkey, string_agg(lower(o_orderstatus), ', ' ORDER BY o_orderkey) AS mood FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3) GROUP BY 1),
d AS (SELECT *, CAST(floor(dur) AS BIGINT) AS w FROM c)
SELECT o_custkey, '# ' || c_name || chr(10) || 'length ' || CASE WHEN w >= 3600 THEN (w // 3600) || ':' || lpad(CAST((w // 60) % 60 AS VARCHAR), 2, '0') ELSE CAST(w // 60 AS VARCHAR) END || ':' || lpad(CAST(w % 60 AS VARCHAR), 2, '0') || ', ' || (60 + o_custkey % 90) || '.0 BPM' || chr(10) || 'caption: ' || c_name || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ' by ' || c_mktsegment END || '. ' || mood || '. Out now.' || chr(10) || 'chapters:' || chr(10) || ch || chr(10)
 || CASE WHEN n > 5 THEN 'pinned comment: the change at ' || (n // 60) || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') ELSE 'note: no moment worth pinning was found' END || CASE WHEN o_custkey % 3 = 0 THEN chr(10) || 'note: no artist is set' ELSE '' END AS text
FROM d JOIN customer ON c_custkey = o_custkey JOIN s USING (o_custkey) JOIN m USING (o_custkey)""")
def release_notes(spark, sf):
    orders = table(spark, sf, "orders")
    facts = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), (F.sum("o_totalprice") / 10000).alias("duration"))
    named = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("seg"))
    k = F.col("o_custkey")
    tracks = facts.join(named, "o_custkey").select("o_custkey", "title", F.when(k % 3 != 0, F.col("seg")).alias("artist"), "duration",
                                                   (60 + k % 90).cast("double").alias("bpm"))
    sections = orders.select("o_custkey", ((F.col("o_orderkey") % 60) * 60).cast("double").alias("start"), F.col("o_orderpriority").alias("name"))
    highs = facts.where("n > 5").select("o_custkey", F.col("n").cast("double").alias("highlight_t"))
    looks = mood_line(orders, ["o_custkey"], "o_orderkey", "o_orderstatus")
    return X.release_notes(tracks, sections, highs, looks, ["o_custkey"])


# ---- packs
@query("pack_round_trip", f"""WITH {WEEKLY} SELECT CAST(series_id AS VARCHAR) AS series_id, frame, round_even(rmsdb * 10, 0) / 10 + 0.0 AS rmsdb, round_even(value * 1000, 0) / 1000 + 0.0 AS rms FROM weekly""")
def pack_round_trip(spark, sf):
    """Levels written as packs and read back through the tag check."""
    levels = weekly_levels(spark, sf).withColumnRenamed("value", "rms")
    path = shared_path(spark, "packs")
    K.write_packs(levels, path, ["rms", "rmsdb"])
    docs, _ = K.read_packs(spark, path, levels=("rms", "rmsdb"))
    return K.pack_frames(docs, ("rms", "rmsdb")).select("series_id", "frame", "rmsdb", "rms")


@query("twin_spec", f"""WITH {WEEKLY}, x AS (SELECT series_id, frame // 120 AS section, value AS v, row_number() OVER (PARTITION BY series_id, frame // 120 ORDER BY value) AS rn, count(*) OVER (PARTITION BY series_id, frame // 120) AS n FROM weekly WHERE frame % 120 < 117)
SELECT series_id, CAST(section AS BIGINT) AS section, round(floor(round(avg(v), 9) / 0.05 + 0.5) * 0.05, 2) AS mean, round(floor(round(max(CASE WHEN rn = floor(0.95 * (n - 1) + 0.5) + 1 THEN v END), 9) / 0.05 + 0.5) * 0.05, 2) AS p95, round(floor(round(max(v), 9) / 0.05 + 0.5) * 0.05, 2) AS max FROM x GROUP BY 1, 2""")
def twin_spec(spark, sf):
    """A coarse twin of each series: per section [mean, p95, max], its last frames left out."""
    from tidewheel.operators.synth import twin_levels

    levels = weekly_levels(spark, sf).withColumn("section", F.floor(F.col("frame") / 120).cast("bigint"))
    inner = levels.where(F.col("frame") % 120 < 117).withColumn("value", F.round("value", 9))
    return twin_levels(inner, ["series_id", "section"], "value")
