"""Queries over inputs with nulls, ties and faults: what is kept, what is refused and why."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded
from terrascreen.operators import compare, guards, linear, scoring, survey
from terrascreen.plans.linear import merge_sql
from terrascreen.plans.registry import query
from terrascreen.plans.survey import _BANDS, _offsets
from terrascreen.plans.views import rnd, sql

REFERENCE = "1996-07-15"

_GAPPY = """nv AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag<>'R' THEN l_returnflag END AS k,
 CASE WHEN l_linenumber=3 THEN NULL WHEN l_orderkey % 10 < 9 THEN 1.0::double ELSE l_extendedprice END AS v FROM lineitem)"""


def _gappy(t):
    value = F.when(F.col("l_linenumber") == 3, None).when(F.col("l_orderkey") % 10 < 9, 1.0).otherwise(F.col("l_extendedprice"))
    key = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    return t.lineitem.select("l_orderkey", "l_linenumber", key.alias("k"), value.alias("v"))


@query("midranks_with_nulls", f"""WITH {_GAPPY} SELECT *, rank() OVER (PARTITION BY k ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY k, v) - 1)/2.0 AS midrank FROM nv""")
def midranks_with_nulls(t):
    return scoring.midranks(_gappy(t), ["k"], "v")


@query("rank_comparison_with_nulls", f"""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus<>'P' THEN o_orderstatus END AS flag, CASE WHEN o_custkey % 7=3 THEN NULL WHEN o_orderkey % 10<9 THEN 1.0::double ELSE o_totalprice END AS a,
     CASE WHEN o_orderkey % 7>0 THEN cast(o_custkey % 50 AS double) END AS b FROM orders),
    r AS (SELECT flag, rank() OVER x + (count(*) OVER (PARTITION BY flag, a) - 1)/2.0 AS ra, rank() OVER y + (count(*) OVER (PARTITION BY flag, b) - 1)/2.0 AS rb,
     row_number() OVER (PARTITION BY flag ORDER BY a DESC NULLS LAST, id) <= 500 AS ta, row_number() OVER (PARTITION BY flag ORDER BY b DESC NULLS LAST, id) <= 500 AS tb
     FROM s WINDOW x AS (PARTITION BY flag ORDER BY a DESC NULLS LAST), y AS (PARTITION BY flag ORDER BY b DESC NULLS LAST))
    SELECT flag, cast(count(*) AS bigint) AS n, {rnd('corr(ra, rb)', 9)} AS spearman, cast(count(*) FILTER (WHERE ta AND tb) AS bigint) AS exact_overlap FROM r GROUP BY flag""")
def rank_comparison_with_nulls(t):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    a = F.when(customer % 7 == 3, None).when(key % 10 < 9, 1.0).otherwise(F.col("o_totalprice"))
    b = F.when(key % 7 > 0, (customer % 50).cast("double"))
    rows = t.orders.select(key.alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("flag"), a.alias("a"), b.alias("b"), F.lit(500).alias("top"))
    return compare.compare_rankings(rows, ["flag"], k="top").select("flag", "n", rounded("spearman", 9).alias("spearman"), "exact_overlap")


_LOOSE = "loose AS (SELECT CASE WHEN route % 4 > 0 THEN route END AS route, a, b FROM intervals)"


@query("interval_merge_with_nulls", sql("intervals", f"{_LOOSE}, {merge_sql('loose', 'route', 'm')} SELECT route, {rnd('a', 6)} AS a, {rnd('b', 6)} AS b FROM m"))
def interval_merge_with_nulls(t):
    loose = t.views.intervals.withColumn("route", F.when(F.col("route") % 4 > 0, F.col("route")))
    return linear.interval_merge(loose, ["route"]).select("route", rounded("a", 6).alias("a"), rounded("b", 6).alias("b"))


@query("run_lengths_with_nulls", sql("frame", """n AS (SELECT CASE WHEN gid > 0 THEN gid END AS gid, idx*5+gid AS pos, CASE WHEN idx % 3 > 0 THEN stratum END AS v FROM frame),
    c AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY pos) - row_number() OVER (PARTITION BY gid, v ORDER BY pos) AS isl FROM n), r AS (SELECT gid, v, count(*) AS n FROM c GROUP BY gid, v, isl)
    SELECT gid, v AS value, cast(count(*) AS bigint) AS runs, cast(max(n) AS bigint) AS longest FROM r GROUP BY gid, v"""))
def run_lengths_with_nulls(t):
    points = t.views.frame.select(F.when(F.col("gid") > 0, F.col("gid")).alias("gid"), (F.col("idx") * 5 + F.col("gid")).alias("pos"), F.when(F.col("idx") % 3 > 0, F.col("stratum")).alias("v"))
    return linear.runs(points, ["gid"], "pos", F.col("v")).groupBy("gid", "value").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


_SHORT = "rl AS (SELECT o_orderkey AS gid, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN -1.0::double ELSE cast((o_orderkey*31) % 4000 AS double)/10.0 END AS route_m FROM orders)"


def _short_routes(t):
    key = F.col("o_orderkey")
    length = F.when(key % 13 == 0, None).when(key % 17 == 0, -1.0).otherwise(((key * 31) % 4000).cast("double") / 10.0)
    return t.orders.select(key.alias("gid"), length.alias("route_m"))


@query("route_violations", f"""WITH {_SHORT} SELECT 'no_length' AS rule, cast(gid AS varchar) AS key FROM rl WHERE route_m IS NULL OR route_m<=0 UNION ALL SELECT 'shorter_than_step', cast(gid AS varchar) FROM rl WHERE route_m>0 AND route_m<2
    UNION ALL SELECT 'shorter_than_window', cast(gid AS varchar) FROM rl WHERE route_m>0 AND route_m<100""")
def route_violations(t):
    return guards.route_violations(_short_routes(t), linear.CHAINAGE_STEP_M, linear.WINDOW_M)


@query("window_remainders", f"WITH {_SHORT} SELECT gid, route_m, cast(floor(route_m/100.0) AS bigint) AS windows, {rnd('route_m-floor(route_m/100.0)*100.0', 6)} AS excluded_m FROM rl WHERE route_m>0")
def window_remainders(t):
    usable = _short_routes(t).where("route_m > 0")
    return guards.window_remainders(usable, linear.WINDOW_M).withColumn("excluded_m", rounded("excluded_m", 6))


@query("interval_violations", """WITH iv AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber=6 THEN NULL ELSE cast(l_quantity AS bigint) END AS a, CASE WHEN l_linenumber=5 THEN NULL ELSE cast(l_partkey % 60 AS bigint) END AS b FROM lineitem)
    SELECT 'no_bound' AS rule, l_orderkey||':'||l_linenumber||':'||coalesce(cast(a AS varchar),'null') AS key FROM iv WHERE a IS NULL OR b IS NULL UNION ALL SELECT 'reversed', l_orderkey||':'||l_linenumber||':'||a FROM iv WHERE b<a""")
def interval_violations(t):
    line = F.col("l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(line != 6, F.col("l_quantity").cast("bigint")).alias("a"), F.when(line != 5, (F.col("l_partkey") % 60).cast("bigint")).alias("b"))
    return guards.interval_violations(rows, ["l_orderkey", "l_linenumber"])


_FAULTY = f"""dy AS (SELECT cell, obs_day, val FROM cube5 WHERE NOT (cell=1 AND month(obs_day)=7 AND day(obs_day)=9) AND NOT (cell=2 AND obs_day=DATE '{REFERENCE}')
 UNION ALL SELECT cell, obs_day, val FROM cube5 WHERE cell=3 AND month(obs_day)=8 AND day(obs_day)=1)"""


@query("season_violations", sql("cube5", f"""{_FAULTY}, n AS (SELECT cell, year(obs_day) AS yr, count(*) AS n, count(DISTINCT obs_day) AS d FROM dy WHERE month(obs_day) IN (6,7,8) GROUP BY 1,2)
    SELECT 'missing_days' AS rule, cell||':'||yr AS key FROM n WHERE d<92 UNION ALL SELECT 'repeated_days', cell||':'||yr FROM n WHERE n>d
    UNION ALL SELECT 'no_reference_day', cast(cell AS varchar) FROM dy GROUP BY cell HAVING count(*) FILTER (WHERE obs_day=DATE '{REFERENCE}' AND val IS NOT NULL)=0"""))
def season_violations(t):
    cube, day = t.views.cube(5).select("cell", "obs_day", "val"), F.col("obs_day")
    lost = ((F.col("cell") == 1) & (F.month(day) == 7) & (F.day(day) == 9)) | ((F.col("cell") == 2) & (day == F.lit(REFERENCE).cast("date")))
    again = cube.where((F.col("cell") == 3) & (F.month(day) == 8) & (F.day(day) == 1))
    return guards.season_violations(cube.where(~lost).unionByName(again), REFERENCE)


_KEPT = """cm AS (SELECT id FROM sites WHERE ord % 3 = 0 UNION ALL SELECT id FROM sites WHERE ord % 30 = 0 UNION ALL SELECT 'x'||id FROM sites WHERE ord % 50 = 0), src AS (SELECT id FROM sites WHERE ord % 7 > 0 UNION ALL SELECT id FROM sites WHERE ord % 11 = 0)"""


@query("kept_sample_violations", sql("sites", f"""{_KEPT} SELECT 'missing_id' AS rule, id AS key FROM cm WHERE id NOT IN (SELECT id FROM src) UNION ALL SELECT 'duplicate_committed', id FROM cm GROUP BY id HAVING count(*)>1
    UNION ALL SELECT 'duplicate_source', id FROM src WHERE id IN (SELECT id FROM cm) GROUP BY id HAVING count(*)>1"""))
def kept_sample_violations(t):
    s, at = t.views.sites, F.col("ord")
    committed = s.where(at % 3 == 0).select("id").unionByName(s.where(at % 30 == 0).select("id")).unionByName(s.where(at % 50 == 0).select(F.concat(F.lit("x"), "id").alias("id")))
    source = s.where(at % 7 > 0).select("id").unionByName(s.where(at % 11 == 0).select("id"))
    return guards.kept_sample_violations(source, committed)


@query("duplicate_lookups", "SELECT 'duplicate_key' AS rule, coalesce(cast(l_suppkey AS varchar),'null')||':'||l_linenumber AS key FROM lineitem GROUP BY l_suppkey, l_linenumber HAVING count(*)>1")
def duplicate_lookups(t):
    return guards.duplicate_keys(t.lineitem, ["l_suppkey", "l_linenumber"])


@query("band_violations", f"""WITH {_BANDS}, f AS (SELECT window_id, band, lobe_m FROM bo WHERE NOT (window_id % 5 = 0 AND band = 2) UNION ALL SELECT window_id, 4, lobe_m FROM bo WHERE window_id % 7 = 0 AND band = 4 UNION ALL SELECT window_id, 6, 12.7 FROM bo WHERE band = 1)
    SELECT window_id, CASE WHEN count(DISTINCT band)<count(*) THEN 'duplicate_band' ELSE 'unresolved' END AS problem FROM f GROUP BY window_id HAVING count(DISTINCT band)<count(*) OR count(*) FILTER (WHERE lobe_m<=0.5)<2""")
def band_violations(t):
    rows, window, band = _offsets(t), F.col("window_id"), F.col("band")
    kept = rows.where(~((window % 5 == 0) & (band == 2)))
    again = rows.where((window % 7 == 0) & (band == 4))
    sixth = rows.where(band == 1).withColumn("band", F.lit(6)).withColumn("lobe_m", F.lit(12.7))
    return survey.band_violations(kept.unionByName(again).unionByName(sixth))


_RETRIEVED = """ft AS (SELECT CASE WHEN s_suppkey % 40=0 THEN s_suppkey-1 ELSE s_suppkey END AS gid, CASE WHEN s_suppkey % 33=0 THEN 'EPSG:4326' ELSE 'EPSG:31370' END AS crs FROM supplier),
    rq AS (SELECT count(*) AS number_matched, count(*)+1 AS number_returned, count(*) AS response_count, count(*) AS response_cap FROM supplier)"""


@query("route_selection_problems", f"""WITH {_RETRIEVED} SELECT 'count_differs' AS rule, number_matched||':'||number_returned||':'||response_count||':'||response_count AS key FROM rq UNION ALL
    SELECT 'possibly_truncated', number_matched||':'||number_returned||':'||response_count||':'||response_count FROM rq UNION ALL SELECT 'frame_changed', number_matched||':'||number_returned||':'||response_count||':'||response_count FROM rq
    UNION ALL SELECT 'other_crs', gid::varchar FROM ft WHERE crs<>'EPSG:31370' UNION ALL SELECT 'duplicate_key', gid::varchar FROM ft GROUP BY gid HAVING count(*)>1""")
def route_selection_problems(t):
    """A retrieval whose counts, frame, ids and reference systems do not fit."""
    key = F.col("s_suppkey")
    features = t.supplier.select(F.when(key % 40 == 0, key - 1).otherwise(key).alias("gid"), F.when(key % 33 == 0, "EPSG:4326").otherwise("EPSG:31370").alias("crs"))
    n = F.count("*")
    request = t.supplier.agg(n.alias("number_matched"), (n + 1).alias("number_returned"), n.alias("response_count"), n.alias("response_cap")).select(
        "*", F.lit("EPSG:31370").alias("crs"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(950.0).alias("x1"), F.lit(999.0).alias("y1"))
    return guards.selection_violations(features, request, "EPSG:31370", (0.0, 0.0, 950.0, 1000.0))
