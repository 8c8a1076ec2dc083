"""Queries that join on position or on keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.functions import geo
from terrascreen.functions.numbers import rounded
from terrascreen.operators import keyed, series, spatial
from terrascreen.plans.expressions import laea_sql, lambert_sql
from terrascreen.plans.registry import query
from terrascreen.plans.views import haversine_sql, rnd, sql

NEAREST = f"""nd AS (SELECT s.*, t.id AS tid, t.ord AS tord, {haversine_sql('s.latitude', 's.longitude', 't.latitude', 't.longitude')} AS d FROM sites s, stations t),
 nr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tord) AS rn FROM nd),
 near AS (SELECT id, ord, street, district, latitude, longitude, heat_pixel, tid AS nearest_station, {rnd('d', 1)} AS distance_m FROM nr WHERE rn=1)"""


def nearest(t):
    return spatial.nearest_station(t.views.sites, t.views.stations)


@query("nearest_station", sql("sites stations", f"{NEAREST} SELECT id, nearest_station, distance_m FROM near"))
def nearest_station(t):
    return nearest(t).select("id", "nearest_station", "distance_m")


_HEAT = "heat AS (SELECT id, heat_pixel AS hp FROM sites WHERE ord % 7 <> 0)"


@query("heat_join", sql("sites stations", f"""{NEAREST}, {_HEAT} SELECT near.id, coalesce(street,'Unnamed street') AS street, coalesce(district,'Unknown') AS district, nearest_station, distance_m, hp AS heat_pixel FROM near JOIN heat USING (id)"""))
def heat_join(t):
    heat = t.views.sites.where(F.col("ord") % 7 != 0)
    joined = keyed.heat_join(nearest(t).drop("heat_pixel"), heat)
    return joined.select("id", "street", "district", "nearest_station", "distance_m", "heat_pixel")


@query("raster_point_join", sql("sites", f"""{lambert_sql('sites')}, ix AS (SELECT id, cast(floor((x-140000.0)/2.0) AS bigint) AS col, cast(floor((178000.0-y)/2.0) AS bigint) AS row FROM lmxy),
    px AS (SELECT DISTINCT col, row, cast((col*7+row*3) % 101 AS bigint) AS value FROM ix WHERE col>=0 AND col<10000 AND row>=0 AND row<9000 AND (col+row) % 13<>0)
    SELECT id, ix.col, ix.row, CASE WHEN value<>0 THEN value END AS heat_value FROM ix LEFT JOIN px ON ix.col=px.col AND ix.row=px.row"""))
def raster_point_join(t):
    xy = geo.with_lambert72(t.views.sites)
    col, row = geo.pixel_index(F.col("x"), F.col("y"))
    index = xy.select(col.alias("col"), row.alias("row")).where(geo.in_raster(F.col("col"), F.col("row")) & ((F.col("col") + F.col("row")) % 13 != 0)).distinct()
    pixels = index.withColumn("value", (F.col("col") * 7 + F.col("row") * 3) % 101)
    return keyed.raster_point_join(t.views.sites, pixels, strict=False).select("id", "col", "row", "heat_value")


RADIUS = f"""rd AS (SELECT t.id, i.flagged, {haversine_sql('i.latitude', 'i.longitude', 't.latitude', 't.longitude')} AS d FROM incidents i, stations t),
 rc AS (SELECT id, count(*) FILTER (WHERE d<=250) AS a, count(*) FILTER (WHERE d<=250 AND flagged) AS b, count(*) FILTER (WHERE d<=500) AS c, count(*) FILTER (WHERE d<=500 AND flagged) AS e FROM rd GROUP BY id)"""


@query("radius_counts", sql("incidents stations", f"""{RADIUS} SELECT id, cast(a AS bigint) AS within_inner, cast(b AS bigint) AS flagged_inner, cast(c AS bigint) AS within_outer, cast(e AS bigint) AS flagged_outer FROM rc"""))
def radius_counts(t):
    return spatial.radius_counts(t.views.incidents, t.views.stations).select("id", "within_inner", "flagged_inner", "within_outer", "flagged_outer")


_CELLS = """sk AS (SELECT *, cast(round_even(latitude/0.25,0)*0.25 AS varchar)||'/'||cast(round_even(longitude/0.25,0)*0.25 AS varchar) AS grid_key FROM sites),
 ce AS (SELECT grid_key, cast(count(*) AS bigint) AS members, max(heat_pixel) AS hottest FROM sk GROUP BY grid_key)"""


@query("cell_join", sql("sites", f"{_CELLS} SELECT id, grid_key, members, hottest FROM sk JOIN ce USING (grid_key)"))
def cell_join(t):
    cells = t.views.sites.groupBy(geo.grid_key(F.col("latitude"), F.col("longitude")).alias("grid_key")).agg(F.count("*").alias("members"), F.max("heat_pixel").alias("hottest"))
    return keyed.cell_join(t.views.sites, cells, ["members", "hottest"]).select("id", "grid_key", "members", "hottest")


_CUBE_AXES = (3900000.0, 3070000.0, 100.0, 400)


@query("cube_point_sample", sql("sites", f"""{laea_sql('sites')}, ci AS (SELECT id, greatest(least(cast(ceil((x-3900000.0)/100.0-0.5) AS bigint),399),0) AS col, greatest(least(cast(ceil((y-3070000.0)/100.0-0.5) AS bigint),399),0) AS row FROM laxy),
    cu AS (SELECT l_partkey*7919 % 400 AS col, l_suppkey*3571 % 400 AS row, cast(l_shipdate AS date) AS obs_day, max(l_quantity) AS val FROM lineitem GROUP BY 1,2,3)
    SELECT cu.col, cu.row, strftime(obs_day,'%Y-%m-%d') AS day_text, val FROM cu WHERE EXISTS (SELECT 1 FROM ci WHERE ci.col=cu.col AND ci.row=cu.row)"""))
def cube_point_sample(t):
    points = keyed.cube_points(t.views.sites, *_CUBE_AXES)
    cube = t.lineitem.groupBy((F.col("l_partkey") * 7919 % 400).alias("col"), (F.col("l_suppkey") * 3571 % 400).alias("row"), F.to_date("l_shipdate").alias("obs_day")).agg(F.max("l_quantity").alias("val"))
    return keyed.cube_point_sample(points, cube).select("col", "row", F.col("obs_day").cast("string").alias("day_text"), "val")


@query("probe_tolerance_join", sql("sites", """rq AS (SELECT ord AS ordinal, round_even(latitude/0.25,0)*0.25 AS latitude, round_even(longitude/0.25,0)*0.25 AS longitude FROM sites),
    rt AS (SELECT ordinal, latitude + (ordinal%3)*0.008 AS r_latitude, longitude - (ordinal%2)*0.003 AS r_longitude, CASE WHEN ordinal%19=0 THEN 'K' ELSE 'C' END AS r_unit, CASE WHEN ordinal%23=0 THEN '2016-08-25' ELSE '2016-08-24' END AS r_day FROM rq WHERE ordinal%29<>0)
    SELECT rq.ordinal, coalesce(abs(latitude-r_latitude)<=0.01 AND abs(longitude-r_longitude)<=0.01 AND r_unit='C' AND r_day='2016-08-24', false) AS agrees FROM rq LEFT JOIN rt USING (ordinal)"""))
def probe_tolerance_join(t):
    requested = t.views.sites.select(F.col("ord").alias("ordinal"), geo.grid_snap(F.col("latitude")).alias("latitude"), geo.grid_snap(F.col("longitude")).alias("longitude"))
    o = F.col("ordinal")
    returned = requested.where(o % 29 != 0).select(
        "ordinal", (F.col("latitude") + (o % 3) * 0.008).alias("r_latitude"), (F.col("longitude") - (o % 2) * 0.003).alias("r_longitude"),
        F.when(o % 19 == 0, "K").otherwise("C").alias("r_unit"), F.when(o % 23 == 0, "2016-08-25").otherwise("2016-08-24").alias("r_day"))
    requested = requested.withColumns({"unit": F.lit("C"), "day": F.lit("2016-08-24")})
    return keyed.tolerance_join(requested, returned).select("ordinal", "agrees")


FLOW = """fs AS (SELECT feature, count(*) AS n_rows, sum(cnt) AS total, count(DISTINCT obs_day) AS days FROM {view} GROUP BY 1),
 fd AS (SELECT feature, obs_day, avg(cnt) AS m, count(DISTINCT slot) AS sl FROM {view} GROUP BY 1,2), fx AS (SELECT feature, min(m) AS lo, max(m) AS hi, min(sl) AS sl FROM fd GROUP BY 1),
 fb AS (SELECT min(obs_day) AS d0, max(obs_day) AS d1, date_diff('day', min(obs_day), max(obs_day))+1 AS nd FROM {view}),
 fr AS (SELECT feature, days, total, lo, hi, n_rows, CASE WHEN total<1 THEN 'no movement recorded' WHEN n_rows<>nd*{k} THEN 'unexpected number of slots' WHEN days<>nd OR sl<>{k} THEN 'missing or duplicate slots' END AS reason FROM fs JOIN fx USING (feature), fb),
 flow AS (SELECT feature, cast(days AS bigint) AS days, total AS observed_total, reason IS NULL AS measured, reason, CASE WHEN reason IS NULL THEN {mean} END AS mean_all, CASE WHEN reason IS NULL THEN {lo} END AS min_day_mean, CASE WHEN reason IS NULL THEN {hi} END AS max_day_mean FROM fr)"""


def flow_sql(per_day: int) -> str:
    return FLOW.format(view=f"slots{per_day}", k=per_day, mean=rnd("total/n_rows", 3), lo=rnd("lo", 3), hi=rnd("hi", 3))


# Mixed coverage: three features keep the whole window, two lose rows of one slot or one day.
MIXED = """mx AS (SELECT * FROM slots4 WHERE NOT (feature='error' AND slot=2 AND day(obs_day)=3) AND NOT (feature='view' AND day(obs_day)=9))"""


def flow_summary(slots):
    bounds = slots.agg(F.struct(F.min("obs_day").alias("lo"), F.max("obs_day").alias("hi")).alias("b")).scalar()
    return series.slot_flow_summary(slots, bounds["lo"], bounds["hi"], 4)


def mixed_slots(t):
    f, s, d = F.col("feature"), F.col("slot"), F.dayofmonth("obs_day")
    return t.views.slots(4).where(~((f == "error") & (s == 2) & (d == 3)) & ~((f == "view") & (d == 9)))


_MIXED_FLOW = FLOW.format(view="mx", k=4, mean=rnd("total/n_rows", 3), lo=rnd("lo", 3), hi=rnd("hi", 3))
_SITE_STATION = "ss AS (SELECT id, CASE ord%7 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' WHEN 4 THEN 'elsewhere' WHEN 5 THEN '' ELSE NULL END AS nearest_station FROM sites)"


def site_station(t):
    kind = F.col("ord") % 7
    name = (F.when(kind == 0, "click").when(kind == 1, "view").when(kind == 2, "error").when(kind == 3, "signup").when(kind == 4, "elsewhere").when(kind == 5, ""))
    return t.views.sites.select("id", name.alias("nearest_station"))


@query("flow_context", sql("sites slots4", f"{MIXED}, {_MIXED_FLOW}, {_SITE_STATION} SELECT id, nearest_station, CASE WHEN coalesce(measured,false) THEN mean_all END AS flow_mean, coalesce(measured,false) AS has_flow FROM ss LEFT JOIN flow ON nearest_station=feature"))
def flow_context(t):
    return series.flow_context(site_station(t), flow_summary(mixed_slots(t)))


@query("stations_without_flow", sql("sites slots4", f"{MIXED}, {_MIXED_FLOW}, {_SITE_STATION} SELECT DISTINCT nearest_station FROM ss LEFT JOIN flow ON nearest_station=feature WHERE NOT coalesce(measured,false) AND coalesce(nearest_station,'')<>''"))
def stations_without_flow(t):
    return series.stations_without_flow(series.flow_context(site_station(t), flow_summary(mixed_slots(t))))


_LIVE = """live AS (SELECT 'v'||id AS id, CASE WHEN ord%13=0 THEN latitude+0.01 ELSE latitude+0.000005 END AS latitude, longitude FROM sites UNION ALL SELECT 'w'||id, latitude, longitude+0.000005 FROM sites WHERE ord%17=0)"""


def live_sites(t):
    s = t.views.sites
    lat = F.when(F.col("ord") % 13 == 0, F.col("latitude") + 0.01).otherwise(F.col("latitude") + 0.000005)
    moved = s.select(F.concat(F.lit("v"), F.col("id")).alias("id"), lat.alias("latitude"), "longitude")
    extra = s.where(F.col("ord") % 17 == 0).select(F.concat(F.lit("w"), F.col("id")).alias("id"), "latitude", (F.col("longitude") + 0.000005).alias("longitude"))
    return moved.unionByName(extra)


@query("crosswalk_match", sql("sites", f"""{_LIVE}, pr AS (SELECT s.id AS legacy_id, l.id AS live_id FROM sites s JOIN live l ON abs(s.latitude-l.latitude)<0.0001 AND abs(s.longitude-l.longitude)<0.0001 AND {haversine_sql('s.latitude', 's.longitude', 'l.latitude', 'l.longitude')}<=2),
    c AS (SELECT s.id AS legacy_id, count(pr.live_id) AS matches, CASE WHEN count(pr.live_id)=1 THEN min(pr.live_id) END AS live_id FROM sites s LEFT JOIN pr ON s.id=pr.legacy_id GROUP BY 1),
    u AS (SELECT live_id, count(*) AS users FROM c WHERE live_id IS NOT NULL GROUP BY 1)
    SELECT legacy_id, c.live_id, cast(matches AS bigint) AS matches, CASE WHEN matches=0 THEN 'none' WHEN matches>1 THEN 'ambiguous' WHEN users>1 THEN 'shared' ELSE 'matched' END AS status FROM c LEFT JOIN u USING (live_id)"""))
def crosswalk_match(t):
    return spatial.crosswalk_match(t.views.sites, live_sites(t))


@query("crosswalk_localize", """WITH x AS (SELECT CASE WHEN n_nationkey%6=0 THEN '' ELSE 'legacy-'||n_name END AS legacy_id, n_name AS live_id FROM nation)
    SELECT c_custkey, CASE WHEN legacy_id<>'' THEN legacy_id END AS id FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN x ON live_id=n_name""")
def crosswalk_localize(t):
    legacy = F.when(F.col("n_nationkey") % 6 == 0, "").otherwise(F.concat(F.lit("legacy-"), F.col("n_name")))
    crosswalk = t.nation.select(legacy.alias("legacy_id"), F.col("n_name").alias("live_id"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("id"), "c_custkey")
    return keyed.crosswalk_localize(rows, crosswalk, strict=False).select("c_custkey", "id")


@query("preserve_sample", sql("sites", """cm AS (SELECT 'c'||lpad(cast(o_custkey AS varchar),7,'0') AS id, min(o_orderkey) AS committed_ord FROM orders GROUP BY o_custkey)
    SELECT sites.id, committed_ord, latitude, longitude FROM sites JOIN cm USING (id)"""))
def preserve_sample(t):
    committed = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("ord")).select(F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("id"), "ord")
    return keyed.preserve_sample(t.views.sites.drop("ord"), committed).select("id", "committed_ord", "latitude", "longitude")


_FRAME_LABELS = """lb AS (SELECT o_orderkey % 5 AS gid, ((o_orderkey // 5) + 0.5)*2.0 + CASE WHEN o_orderkey%37=0 THEN 0.4 ELSE 0 END AS chainage, CASE o_custkey%3 WHEN 0 THEN 'canopy' WHEN 1 THEN 'not_canopy' ELSE 'unknown' END AS label FROM orders
    UNION ALL SELECT o_orderkey % 5, ((o_orderkey // 5) + 0.5)*2.0, 'canopy' FROM orders WHERE o_orderkey%41=0)"""


def frame_labels(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    chainage = (F.floor(o / 5) + 0.5) * 2.0
    label = F.when(c % 3 == 0, "canopy").when(c % 3 == 1, "not_canopy").otherwise("unknown")
    first = t.orders.select((o % 5).alias("gid"), (chainage + F.when(o % 37 == 0, 0.4).otherwise(0.0)).alias("chainage"), label.alias("label"))
    again = t.orders.where(o % 41 == 0).select((o % 5).alias("gid"), chainage.alias("chainage"), F.lit("canopy").alias("label"))
    return first.unionByName(again)


@query("label_frame_join", sql("frame", f"""{_FRAME_LABELS}, k AS (SELECT gid, round(chainage*1e6) AS mk, count(*) AS uses FROM lb GROUP BY 1,2)
    SELECT lb.gid, {rnd('lb.chainage', 6)} AS chainage, lb.label, f.stratum, CASE WHEN f.stratum IS NULL THEN 'not_a_candidate' WHEN k.uses>1 THEN 'duplicate' ELSE 'ok' END AS status
    FROM lb JOIN k ON lb.gid=k.gid AND round(lb.chainage*1e6)=k.mk LEFT JOIN frame f ON f.gid=lb.gid AND round(f.chainage*1e6)=round(lb.chainage*1e6)"""))
def label_frame_join(t):
    return keyed.label_frame_join(t.views.frame, frame_labels(t)).select("gid", rounded("chainage", 6).alias("chainage"), "label", "stratum", "status")


_STAGES = """st AS (SELECT id, ord, latitude, ord%7<>0 AS has_heat, ord%11<>0 AS has_near, ord%13<>0 AS has_flow, ord%3<>0 AS measured, ord%17<>0 AS located FROM sites)"""


def stage_tables(t):
    s = t.views.sites
    has = lambda n: s.where(F.col("ord") % n != 0)
    both = s.where((F.col("ord") % 7 != 0) & (F.col("ord") % 11 != 0))
    return {"coordinates": has(17), "heat": has(7), "mobility": has(11), "analysis": both, "flow": has(13),
            "measured_flow": s.where((F.col("ord") % 13 != 0) & (F.col("ord") % 3 != 0))}


@query("unmatched_audit", sql("sites", f"""{_STAGES} SELECT 'coordinates' AS stage, id, ord FROM st WHERE NOT located UNION ALL SELECT 'heat', id, ord FROM st WHERE NOT has_heat UNION ALL SELECT 'mobility', id, ord FROM st WHERE NOT has_near
    UNION ALL SELECT 'analysis', id, ord FROM st WHERE NOT (has_heat AND has_near) UNION ALL SELECT 'flow', id, ord FROM st WHERE NOT has_flow UNION ALL SELECT 'measured_flow', id, ord FROM st WHERE NOT (has_flow AND measured)"""))
def unmatched_audit(t):
    return keyed.unmatched_audit(t.views.sites, stage_tables(t))


_PAIR = """mean_s AS (SELECT l_suppkey%5 AS cell, cast(l_shipdate AS date) AS obs_day, avg(l_quantity) AS val FROM lineitem GROUP BY 1,2 HAVING NOT (l_suppkey%5=3 AND day(cast(l_shipdate AS date))=13)),
 max_s AS (SELECT l_suppkey%5 AS cell, cast(l_shipdate AS date) AS obs_day, max(l_quantity) - CASE WHEN l_suppkey%5=4 THEN 20 ELSE 0 END AS val FROM lineitem GROUP BY l_suppkey%5, cast(l_shipdate AS date) HAVING NOT (l_suppkey%5=2 AND month(cast(l_shipdate AS date))=2)),
 pj AS (SELECT coalesce(a.cell,b.cell) AS cell, coalesce(a.obs_day,b.obs_day) AS obs_day, a.val AS v1, b.val AS v2 FROM mean_s a FULL JOIN max_s b ON a.cell=b.cell AND a.obs_day=b.obs_day)"""


def pair_tables(t):
    keys = [(F.col("l_suppkey") % 5).alias("cell"), F.to_date("l_shipdate").alias("obs_day")]
    mean = t.lineitem.groupBy(*keys).agg(F.avg("l_quantity").alias("val")).where(~((F.col("cell") == 3) & (F.dayofmonth("obs_day") == 13)))
    top = t.lineitem.groupBy(*keys).agg(F.max("l_quantity").alias("val")).where(~((F.col("cell") == 2) & (F.month("obs_day") == 2)))
    return mean, top.withColumn("val", F.col("val") - F.when(F.col("cell") == 4, 20).otherwise(0))


@query("paired_series_join", sql("", f"""{_PAIR} SELECT cell, strftime(obs_day,'%Y-%m-%d') AS day_text, CASE WHEN v1 IS NULL THEN 'missing_first' WHEN v2 IS NULL THEN 'missing_second' ELSE 'second_below_first' END AS problem FROM pj WHERE v1 IS NULL OR v2 IS NULL OR v2-v1 < -1e-8"""))
def paired_series_join(t):
    _, problems = keyed.paired_series(*pair_tables(t), ["cell", "obs_day"])
    return problems.select("cell", F.col("obs_day").cast("string").alias("day_text"), "problem")


@query("zero_delta_fraction", sql("", f"""{_PAIR}, ok AS (SELECT v2-v1 AS d FROM pj WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND NOT v2-v1 < -1e-8)
    SELECT cast(count(*) AS bigint) AS paired, {rnd('min(d)', 9)} AS min_delta, {rnd('avg(CASE WHEN d=0 THEN 1.0 ELSE 0.0 END)', 9)} AS zero_fraction, count(*) FILTER (WHERE d<>0)=0 AS all_equal FROM ok"""))
def zero_delta_fraction(t):
    pairs, _ = keyed.paired_series(*pair_tables(t), ["cell", "obs_day"])
    return keyed.pair_summary(pairs)


@query("id_set_equality", """SELECT coalesce(a.id,b.id) AS id, CASE WHEN b.id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT o_custkey AS id FROM orders) a
    FULL JOIN (SELECT DISTINCT c_custkey + 20 AS id FROM customer) b ON a.id=b.id WHERE a.id IS NULL OR b.id IS NULL""")
def id_set_equality(t):
    return keyed.id_set_equality(t.orders.select(F.col("o_custkey").alias("id")), t.customer.select((F.col("c_custkey") + 20).alias("id")))


_SETS = "a AS (SELECT DISTINCT year(o_orderdate) AS yr, o_custkey AS item FROM orders WHERE o_orderstatus='F'), b AS (SELECT DISTINCT year(o_orderdate) AS yr, o_custkey AS item FROM orders WHERE o_orderpriority='1-URGENT')"


def _set_tables(t):
    rows = t.orders.select(F.year("o_orderdate").cast("bigint").alias("yr"), F.col("o_custkey").alias("item"), "o_orderstatus", "o_orderpriority")
    return rows.where("o_orderstatus = 'F'"), rows.where("o_orderpriority = '1-URGENT'")


@query("set_overlap", f"WITH {_SETS} SELECT a.yr, cast(count(*) AS bigint) AS overlap FROM a JOIN b ON a.yr=b.yr AND a.item=b.item GROUP BY 1")
def set_overlap(t):
    return keyed.set_overlap(*_set_tables(t), ["yr"], "item").select("yr", "overlap")


@query("set_jaccard", f"""WITH {_SETS}, j AS (SELECT coalesce(a.yr,b.yr) AS yr, a.item AS x, b.item AS y FROM a FULL JOIN b ON a.yr=b.yr AND a.item=b.item)
    SELECT yr, {rnd('count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL)/count(*)', 9)} AS jaccard, cast(count(*) AS bigint) AS union_size FROM j GROUP BY 1""")
def set_jaccard(t):
    return keyed.set_overlap(*_set_tables(t), ["yr"], "item").select("yr", rounded("jaccard", 9).alias("jaccard"), "union_size")


@query("set_difference_guard", """WITH e AS (SELECT DISTINCT c_custkey AS id FROM customer), a AS (SELECT DISTINCT o_custkey + 3 AS id FROM orders)
    SELECT id, 'missing' AS problem FROM e WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'unknown' FROM a WHERE id NOT IN (SELECT id FROM e)""")
def set_difference_guard(t):
    return keyed.set_difference(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select((F.col("o_custkey") + 3).alias("id")), "id")


@query("year_histogram", sql("incidents", "SELECT yr, cast(count(*) AS bigint) AS incidents, cast(count(*) FILTER (WHERE flagged) AS bigint) AS flagged FROM incidents GROUP BY yr"))
def year_histogram(t):
    located = t.views.incidents.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return located.groupBy("yr").agg(F.count("*").alias("incidents"), F.count_if("flagged").alias("flagged"))
