"""Queries of the data-quality rules: derived tables with known faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.functions import geo
from terrascreen.operators import keyed, quality, regions, series, spatial
from terrascreen.operators.ordering import materialise
from terrascreen.plans.expressions import laea_sql, lambert_sql
from terrascreen.plans.joins import _MIXED_FLOW, _SITE_STATION, MIXED, NEAREST, RADIUS, flow_summary, mixed_slots, nearest, site_station
from terrascreen.plans.registry import query
from terrascreen.plans.seasons import CUBE_METRICS, cube_metrics
from terrascreen.plans.views import sql


def _rules(source: str, key: str, checks: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, cast({key} AS varchar) AS key FROM {source} WHERE coalesce({bad}, true)" for rule, bad in checks)


_KEYED = "kr AS (SELECT CASE WHEN ord%53=0 THEN '' WHEN ord%59=0 THEN 'c0000001' WHEN ord%61=0 THEN id||'x' ELSE id END AS id FROM sites)"


@query("dq_keys", sql("sites", f"""{_KEYED}, kc AS (SELECT id, count(*) AS n FROM kr GROUP BY 1) SELECT 'empty_id' AS rule, cast(n AS varchar) AS key FROM kc WHERE id='' UNION ALL SELECT 'duplicate_id', id FROM kc WHERE n>1 AND id<>''
    UNION ALL SELECT 'missing_id', id FROM sites WHERE id NOT IN (SELECT id FROM kc) UNION ALL SELECT 'unknown_id', id FROM kc WHERE id<>'' AND id NOT IN (SELECT id FROM sites)
    UNION ALL SELECT 'declared_total', cast((SELECT count(*) FROM supplier) AS varchar) WHERE (SELECT count(*) FROM supplier) < (SELECT count(*) FROM kr)
    UNION ALL SELECT 'row_count', cast((SELECT count(*) FROM kr) AS varchar) WHERE (SELECT count(*) FROM kr) <> (SELECT count(*) FROM nation)"""))
def dq_keys(t):
    o, i = F.col("ord"), F.col("id")
    rows = t.views.sites.select(F.when(o % 53 == 0, "").when(o % 59 == 0, "c0000001").when(o % 61 == 0, F.concat(i, F.lit("x"))).otherwise(i).alias("id"))
    return quality.dq_keys(rows, t.views.sites, t.supplier.agg(F.count("*")).scalar(), row_count=t.nation.agg(F.count("*")).scalar())


@query("dq_copied_fields", sql("sites", """cf AS (SELECT id, street, latitude, longitude, CASE WHEN ord%17=0 THEN 'moved' ELSE street END AS street2, CASE WHEN ord%23=0 THEN latitude+0.001 ELSE latitude END AS latitude2 FROM sites)
    SELECT 'street' AS rule, id AS key FROM cf WHERE street IS DISTINCT FROM street2 UNION ALL SELECT 'latitude', id FROM cf WHERE latitude<>latitude2"""))
def dq_copied_fields(t):
    s = t.views.sites
    copy = s.select("id", F.when(F.col("ord") % 17 == 0, "moved").otherwise(F.col("street")).alias("street"),
                    F.when(F.col("ord") % 23 == 0, F.col("latitude") + 0.001).otherwise(F.col("latitude")).alias("latitude"), "longitude")
    return quality.dq_copied_fields(copy, s, "id", ["street", "latitude", "longitude"])


_RANGED = "rg AS (SELECT id, CASE WHEN ord%31=0 THEN 101.0 WHEN ord%37=0 THEN 50.5 WHEN ord%41=0 THEN NULL ELSE heat_pixel END::double AS heat, CASE WHEN ord%43=0 THEN 51.5 ELSE latitude END AS latitude, longitude FROM sites)"


@query("dq_ranges", sql("sites", f"{_RANGED} " + _rules("rg", "id", [("heat_range", "NOT heat BETWEEN 1 AND 100"), ("latitude_range", "NOT latitude BETWEEN 50.7 AND 51.0"), ("longitude_range", "NOT longitude BETWEEN 4.1 AND 4.7"), ("heat_integer", "heat<>round(heat)")])))
def dq_ranges(t):
    o = F.col("ord")
    heat = F.when(o % 31 == 0, 101.0).when(o % 37 == 0, 50.5).when(o % 41 == 0, F.lit(None)).otherwise(F.col("heat_pixel").cast("double"))
    rows = t.views.sites.select("id", heat.alias("heat"), F.when(o % 43 == 0, 51.5).otherwise(F.col("latitude")).alias("latitude"), "longitude")
    e = geo.ENVELOPE
    return quality.dq_ranges(rows, "id", {"heat": (1, 100), "latitude": (e["lat_min"], e["lat_max"]), "longitude": (e["lon_min"], e["lon_max"])}, ["heat"])


@query("dq_orderings", sql("", """od AS (SELECT l_orderkey%500 AS id, min(l_quantity) AS lo, avg(l_quantity) + CASE WHEN (l_orderkey%500)%50=7 THEN 60 ELSE 0 END AS mid, max(l_quantity) - CASE WHEN (l_orderkey%500)%70=3 THEN 49 ELSE 0 END AS hi FROM lineitem GROUP BY l_orderkey%500)
    SELECT 'lo_above_mid' AS rule, cast(id AS varchar) AS key FROM od WHERE lo>mid UNION ALL SELECT 'mid_above_hi', cast(id AS varchar) FROM od WHERE mid>hi+0.01 UNION ALL SELECT 'lo_above_hi', cast(id AS varchar) FROM od WHERE lo>hi"""))
def dq_orderings(t):
    i = F.col("id")
    rows = t.lineitem.groupBy((F.col("l_orderkey") % 500).alias("id")).agg(F.min("l_quantity").alias("lo"), F.avg("l_quantity").alias("mid"), F.max("l_quantity").alias("hi"))
    rows = rows.withColumns({"mid": F.col("mid") + F.when(i % 50 == 7, 60).otherwise(0), "hi": F.col("hi") - F.when(i % 70 == 3, 49).otherwise(0)})
    return quality.dq_orderings(rows, "id", [("lo", "mid", 0), ("mid", "hi", 0.01), ("lo", "hi", 0)])


@query("dq_recompute_nearest", sql("sites stations", f"""{NEAREST} SELECT 'nearest_station' AS rule, id AS key FROM near WHERE ord%60=1 AND ord%97<>5 AND nearest_station<>'s00001' UNION ALL SELECT 'distance_m', id FROM near WHERE ord%50=0 AND ord%97<>5 UNION ALL SELECT 'not_stored', id FROM near WHERE ord%97=5"""))
def dq_recompute_nearest(t):
    fresh = materialise(nearest(t), "nearest")
    o = F.col("ord")
    stored = fresh.where(o % 97 != 5).select("id", F.when(o % 60 == 1, "s00001").otherwise(F.col("nearest_station")).alias("nearest_station"),
                                             (F.col("distance_m") + F.when(o % 50 == 0, 1.0).otherwise(0.0)).alias("distance_m"))
    found = quality.compare_tables(stored, fresh, ["id"], {"nearest_station": None, "distance_m": 1e-6})
    return found


@query("dq_recompute_pixel", sql("sites", f"{lambert_sql('sites', 'id, ord')} SELECT 'pixel_column' AS rule, id AS key FROM lmxy WHERE ord%29=0 UNION ALL SELECT 'pixel_row', id FROM lmxy WHERE ord%34=0"))
def dq_recompute_pixel(t):
    placed = geo.with_lambert72(t.views.sites)
    col, row = geo.pixel_index(F.col("x"), F.col("y"))
    o = F.col("ord")
    stored = placed.select("id", "latitude", "longitude", (col + F.when(o % 29 == 0, 1).otherwise(0)).alias("heat_column"), (row + F.when(o % 34 == 0, 1).otherwise(0)).alias("heat_row"))
    return quality.dq_pixels(stored)


@query("dq_recompute_flow", sql("slots4", f"""{MIXED}, {_MIXED_FLOW} SELECT 'observed_total' AS rule, feature AS key FROM flow WHERE feature='click' UNION ALL SELECT 'days', feature FROM flow WHERE feature='signup' UNION ALL SELECT 'measured', feature FROM flow WHERE feature='error' UNION ALL SELECT 'not_stored', feature FROM flow WHERE feature='view'"""))
def dq_recompute_flow(t):
    fresh = materialise(flow_summary(mixed_slots(t)), "flow")
    f = F.col("feature")
    stored = fresh.where(f != "view").withColumns({
        "observed_total": F.col("observed_total") + F.when(f == "click", 100).otherwise(0), "days": F.col("days") - F.when(f == "signup", 1).otherwise(0),
        "measured": F.when(f == "error", ~F.col("measured")).otherwise(F.col("measured"))})
    return quality.compare_tables(stored, fresh, ["feature"], {"days": None, "measured": None, "observed_total": 1e-9, "mean_all": 1e-9, "min_day_mean": 1e-9, "max_day_mean": 1e-9})


@query("dq_recompute_incidents", sql("incidents stations", f"""{RADIUS}, sd AS (SELECT id, a + CASE WHEN right(id,1)='3' THEN c+1 ELSE 0 END AS a, b, c, e + CASE WHEN right(id,1)='5' THEN c+1 ELSE 0 END AS e, a AS a0, b AS b0, c AS c0, e AS e0 FROM rc)
    SELECT 'within_inner' AS rule, id AS key FROM sd WHERE a<>a0 UNION ALL SELECT 'flagged_outer', id FROM sd WHERE e<>e0 UNION ALL SELECT 'within_inner_above_within_outer', id FROM sd WHERE a>c UNION ALL SELECT 'flagged_inner_above_within_inner', id FROM sd WHERE b>a
    UNION ALL SELECT 'flagged_outer_above_within_outer', id FROM sd WHERE e>c UNION ALL SELECT 'flagged_inner_above_flagged_outer', id FROM sd WHERE b>e UNION ALL SELECT 'record_count', cast(count(*)+1 AS varchar) FROM incidents
    UNION ALL SELECT 'street', id FROM stations WHERE right(id,1)='7'"""))
def dq_recompute_incidents(t):
    fresh = materialise(spatial.radius_counts(t.views.incidents, t.views.stations), "radius")
    last = F.right("id", F.lit(1))
    stored = fresh.withColumns({"within_inner": F.col("within_inner") + F.when(last == "3", F.col("within_outer") + 1).otherwise(0),
                                "flagged_outer": F.col("flagged_outer") + F.when(last == "5", F.col("within_outer") + 1).otherwise(0)})
    count = t.views.incidents.agg(F.count("*") + 1).scalar()
    copied = fresh.withColumn("street", F.when(last == "7", "elsewhere").otherwise(F.col("street")))
    fields = quality.dq_copied_fields(copied.select("id", "street", "latitude", "longitude"), t.views.stations, "id", ["street", "latitude", "longitude"])
    return quality.dq_incidents(stored, fresh, t.views.incidents, count).unionByName(fields)


_CELL_FAULTS = """sk AS (SELECT id, ord, latitude, longitude, cast(round_even(latitude/0.25,0)*0.25 AS varchar)||'/'||cast(round_even(longitude/0.25,0)*0.25 AS varchar) AS snap, heat_pixel FROM sites), cl AS (SELECT snap AS grid_key, max(heat_pixel) AS hottest FROM sk GROUP BY 1),
 ca AS (SELECT * FROM cl UNION ALL SELECT '0.0/0.0', 1), rc AS (SELECT id, ord, snap, CASE WHEN ord%71=0 THEN '9.0/9.0' WHEN ord%73=0 THEN '0.0/0.25' ELSE snap END AS grid_key FROM sk), rv AS (SELECT rc.*, cl.hottest + CASE WHEN ord%79=0 THEN 1 ELSE 0 END AS hottest FROM rc JOIN cl ON rc.snap=cl.grid_key)"""


@query("dq_recompute_cells", sql("sites", f"""{_CELL_FAULTS} SELECT 'wrong_cell' AS rule, id AS key FROM rv WHERE grid_key<>snap UNION ALL SELECT 'unknown_cell', id FROM rv WHERE grid_key NOT IN (SELECT grid_key FROM ca) UNION ALL SELECT 'hottest', id FROM rv JOIN ca USING (grid_key) WHERE rv.hottest<>ca.hottest
    UNION ALL SELECT 'unused_cell', grid_key FROM ca WHERE grid_key NOT IN (SELECT grid_key FROM rv)"""))
def dq_recompute_cells(t):
    snap = geo.grid_key(F.col("latitude"), F.col("longitude"))
    cells = t.views.sites.groupBy(snap.alias("grid_key")).agg(F.max("heat_pixel").alias("hottest"))
    extra = t.region.agg(F.lit("0.0/0.0").alias("grid_key"), F.lit(1).cast("bigint").alias("hottest"))
    joined = keyed.cell_join(t.views.sites, cells, ["hottest"], strict=False)
    o = F.col("ord")
    records = joined.select("id", F.when(o % 71 == 0, "9.0/9.0").when(o % 73 == 0, "0.0/0.25").otherwise(F.col("grid_key")).alias("grid_key"),
                            (F.col("hottest") + F.when(o % 79 == 0, 1).otherwise(0)).alias("hottest"))
    return quality.dq_cells(t.views.sites, records, cells.unionByName(extra), ["hottest"])


@query("dq_recompute_cube", sql("sites", f"""{laea_sql('sites', 'id, ord')}, ci AS (SELECT id, ord, x, y, cast(ceil((x-3900000.0)/100.0-0.5) AS bigint) AS col, cast(ceil((y-3070000.0)/100.0-0.5) AS bigint) AS row FROM laxy),
    sc AS (SELECT *, 3900000.0+col*100.0+CASE WHEN ord%83=0 THEN 200 ELSE 0 END AS cell_x, 3070000.0+row*100.0-CASE WHEN ord%89=0 THEN 200 ELSE 0 END AS cell_y FROM ci)
    SELECT 'cell_x' AS rule, id AS key FROM sc WHERE abs(x-cell_x)>50.000001 UNION ALL SELECT 'cell_y', id FROM sc WHERE abs(y-cell_y)>50.000001 UNION ALL SELECT 'cell_centre', col||':'||row FROM sc GROUP BY col, row HAVING min(cell_x)<>max(cell_x) OR min(cell_y)<>max(cell_y)"""))
def dq_recompute_cube(t):
    points = keyed.cube_points(t.views.sites, 3900000.0, 3070000.0, 100.0, 400)
    o = F.col("ord")
    records = points.select("id", "latitude", "longitude", "col", "row", (3900000.0 + F.col("col") * 100.0 + F.when(o % 83 == 0, 200).otherwise(0)).alias("cell_x"),
                            (3070000.0 + F.col("row") * 100.0 - F.when(o % 89 == 0, 200).otherwise(0)).alias("cell_y"))
    return quality.dq_cube(records, 3900000.0, 3070000.0, 100.0)


@query("dq_percentile_rank", sql("cube5", f"""{CUBE_METRICS}, z AS (SELECT cell, count(*) AS n FROM se GROUP BY 1), p AS (SELECT cell, reference_percentile + CASE WHEN cell%2=1 THEN 1 ELSE 0 END AS pc, reference_rank, n FROM cube_m JOIN z USING (cell))
    SELECT 'percentile_rank' AS rule, cast(cell AS varchar) AS key FROM p WHERE coalesce(abs(pc-100.0*(reference_rank-1)/n)>0.05+1e-9, true)"""))
def dq_percentile_rank(t):
    sizes = t.views.cube(5).where(F.month("obs_day").isin(6, 7, 8)).groupBy("cell").agg(F.count("*").alias("n"))
    rows = cube_metrics(t).join(sizes, "cell").withColumn("reference_percentile", F.col("reference_percentile") + F.when(F.col("cell") % 2 == 1, 1).otherwise(0))
    return quality.dq_percentile_rank(rows, "cell", "reference_percentile", "reference_rank", F.col("n"))


@query("dq_inventory", """WITH a AS (SELECT n_name AS dataset, r_name AS licence, 'credit '||n_regionkey AS credit FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey%9<>0),
    e AS (SELECT n_name AS dataset, 'licence' AS field, CASE WHEN n_nationkey%4=1 THEN 'other' ELSE r_name END AS value FROM nation JOIN region ON n_regionkey=r_regionkey UNION ALL SELECT n_name, 'credit', 'credit '||(n_nationkey%5) FROM nation),
    f AS (SELECT dataset, 'licence' AS field, licence AS v FROM a UNION ALL SELECT dataset, 'credit', credit FROM a)
    SELECT CASE WHEN v IS NULL THEN 'not_declared' ELSE 'differs' END AS rule, dataset||':'||e.field AS key FROM e LEFT JOIN f USING (dataset, field) WHERE v IS NULL OR v<>value""")
def dq_inventory(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    actual = joined.where(k % 9 != 0).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("licence"), F.concat(F.lit("credit "), F.col("n_regionkey").cast("string")).alias("credit"))
    expected = joined.select(F.col("n_name").alias("dataset"), F.when(k % 4 == 1, "other").otherwise(F.col("r_name")).alias("licence"), F.concat(F.lit("credit "), (k % 5).cast("string")).alias("credit"))
    return quality.dq_contract(quality.field_values(actual, "dataset", ["licence", "credit"]), quality.field_values(expected, "dataset", ["licence", "credit"]))


_DAILY_FAULTS = """dv AS (SELECT l_suppkey%20 AS cell, cast(l_shipdate AS date) AS obs_day, min(l_quantity) AS tmin, max(l_quantity) - CASE WHEN (l_suppkey%20)=3 AND day(cast(l_shipdate AS date))=9 THEN 200 ELSE 0 END AS tmax,
 CASE WHEN (l_suppkey%20)=5 AND day(cast(l_shipdate AS date))=11 THEN NULL ELSE avg(l_discount)*1000 END AS rh, CASE WHEN l_suppkey%20=7 THEN 'K' ELSE 'C' END AS tmax_unit FROM lineitem GROUP BY l_suppkey%20, cast(l_shipdate AS date))"""


@query("dq_series_values", sql("", f"""{_DAILY_FAULTS}, k AS (SELECT *, cell||':'||cast(obs_day AS varchar) AS kk FROM dv) SELECT 'tmin_range' AS rule, kk AS key FROM k WHERE NOT tmin BETWEEN -40 AND 45 UNION ALL SELECT 'tmax_range', kk FROM k WHERE NOT tmax BETWEEN -40 AND 45
    UNION ALL SELECT 'rh_finite', kk FROM k WHERE rh IS NULL UNION ALL SELECT 'rh_range', kk FROM k WHERE NOT rh BETWEEN 0 AND 100 UNION ALL SELECT 'minimum_above_maximum', kk FROM k WHERE tmin>tmax UNION ALL SELECT 'tmax_unit', kk FROM k WHERE tmax_unit<>'C'
    UNION ALL SELECT 'missing_days', cast(cell AS varchar) FROM k GROUP BY cell HAVING count(DISTINCT obs_day) < date_diff('day', min(obs_day), max(obs_day))+1"""))
def dq_series_values(t):
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("cell"), F.to_date("l_shipdate").alias("obs_day")).agg(F.min("l_quantity").alias("tmin"), F.max("l_quantity").alias("tmax"), (F.avg("l_discount") * 1000).alias("rh"))
    c, d = F.col("cell"), F.dayofmonth("obs_day")
    rows = rows.withColumns({"tmax": F.col("tmax") - F.when((c == 3) & (d == 9), 200).otherwise(0), "rh": F.when(~((c == 5) & (d == 11)), F.col("rh")), "tmax_unit": F.when(c == 7, "K").otherwise("C")})
    return quality.dq_series_values(rows, "cell", {"tmin": (-40, 45), "tmax": (-40, 45), "rh": (0, 100)}, "tmin", "tmax", {"tmax": "C"})


@query("dq_source_contract", """WITH a AS (SELECT source AS dataset, min(lang) AS crs, cast(max(n_chars)>15000 AS varchar) AS semantics FROM documents GROUP BY 1), f AS (SELECT dataset, 'crs' AS field, crs AS v FROM a UNION ALL SELECT dataset, 'semantics', semantics FROM a),
    e AS (SELECT dataset, field, CASE field WHEN 'crs' THEN 'de' ELSE 'true' END AS value FROM f) SELECT 'differs' AS rule, e.dataset||':'||e.field AS key FROM e JOIN f USING (dataset, field) WHERE v<>value""")
def dq_source_contract(t):
    actual = t.documents.groupBy(F.col("source").alias("dataset")).agg(F.min("lang").alias("crs"), (F.max("n_chars") > 15000).cast("string").alias("semantics"))
    expected = actual.select("dataset").withColumns({"crs": F.lit("de"), "semantics": F.lit("true")})
    return quality.dq_contract(quality.field_values(actual, "dataset", ["crs", "semantics"]), quality.field_values(expected, "dataset", ["crs", "semantics"]))


@query("dq_provenance_uniform", """SELECT 'mixed_provenance' AS rule, cast(o_custkey AS varchar) AS key FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY o_custkey HAVING count(*)>1""")
def dq_provenance_uniform(t):
    return quality.dq_provenance(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("dq_raster_uniform", """WITH px AS (SELECT l_orderkey*7 % 10000 AS col, l_partkey*13 % 9000 AS row, 7 AS value FROM lineitem), s AS (SELECT min(value) AS lo, max(value) AS hi FROM px WHERE row%11=1 AND col%13=1)
    SELECT 'uniform_raster' AS rule, cast(lo AS varchar) AS key FROM s WHERE lo IS NULL OR lo=hi UNION ALL SELECT DISTINCT 'outside_raster', col||':'||row FROM px WHERE col>=9990 OR row>=8990""")
def dq_raster_uniform(t):
    pixels = t.lineitem.select((F.col("l_orderkey") * 7 % 10000).alias("col"), (F.col("l_partkey") * 13 % 9000).alias("row"), F.lit(7).alias("value"))
    return quality.dq_raster_uniform(pixels, 11, 13, 9_990, 8_990)


@query("dq_raster_varied", """WITH px AS (SELECT DISTINCT l_orderkey*7 % 10000 AS col, l_partkey*13 % 9000 AS row, cast(l_quantity*6 AS bigint) AS value FROM lineitem), s AS (SELECT min(value) AS lo, max(value) AS hi FROM px WHERE row%11=1 AND col%13=1)
    SELECT 'uniform_raster' AS rule, cast(lo AS varchar) AS key FROM s WHERE lo IS NULL OR lo=hi UNION ALL SELECT 'value_type', col||':'||row FROM px WHERE value>255""")
def dq_raster_varied(t):
    """The other branch: values that vary, some of them too large for eight bits."""
    pixels = t.lineitem.select((F.col("l_orderkey") * 7 % 10000).alias("col"), (F.col("l_partkey") * 13 % 9000).alias("row"), (F.col("l_quantity") * 6).cast("bigint").alias("value"))
    return quality.dq_raster_uniform(pixels, 11, 13)


_LABEL_ROWS = """lr AS (SELECT cast(conv_id AS varchar)||':'||turn AS key, CASE WHEN conv_id%9=0 THEN 'tree' WHEN role='user' THEN 'canopy' ELSE 'unknown' END AS label, CASE WHEN turn=1 AND conv_id%5=0 THEN ' ' ELSE role END AS interpreter,
 CASE WHEN conv_id%6=0 THEN '2026-02-30' WHEN conv_id%6=1 THEN '2026/01/01' ELSE '2026-06-15' END AS day_text, conv_id%8=0 AS extra FROM conversations)"""


@query("dq_labels", f"""WITH {_LABEL_ROWS} SELECT 'label' AS rule, key FROM lr WHERE label NOT IN ('canopy','not_canopy','unknown') UNION ALL SELECT 'interpreter', key FROM lr WHERE trim(interpreter)='' UNION ALL SELECT 'date', key FROM lr WHERE day_text<>'2026-06-15' UNION ALL SELECT 'fields', key FROM lr WHERE extra
    UNION ALL SELECT 'leaf_on', source FROM documents GROUP BY source HAVING count(*)%2=0 UNION ALL SELECT 'reference_definition', source FROM documents GROUP BY source HAVING count(*)%3=0""")
def dq_labels(t):
    c = F.col("conv_id")
    rows = t.conversations.select(
        F.concat_ws(":", c.cast("string"), F.col("turn").cast("string")).alias("key"), F.when(c % 9 == 0, "tree").when(F.col("role") == "user", "canopy").otherwise("unknown").alias("label"),
        F.when((F.col("turn") == 1) & (c % 5 == 0), " ").otherwise(F.col("role")).alias("interpreter"), F.when(c % 6 == 0, "2026-02-30").when(c % 6 == 1, "2026/01/01").otherwise("2026-06-15").alias("day_text"),
        F.when(c % 8 == 0, F.array(F.lit("colour"))).otherwise(F.array().cast("array<string>")).alias("unknown_fields"))
    files = t.documents.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n")).select(
        "file", F.when(F.col("n") % 3 == 0, "").otherwise("canopy over the line").alias("reference_definition"), F.lit("photo, then street, then field").alias("source_hierarchy"),
        (F.col("n") % 2 == 1).alias("leaf_on"), F.lit(True).alias("blinded"))
    return quality.dq_labels(rows).unionByName(quality.dq_protocol(files))


_REVIEWS = """rvw AS (SELECT c_custkey, 'p'||c_custkey AS proposal_id, CASE c_custkey%6 WHEN 0 THEN '' WHEN 1 THEN 'accepted' WHEN 2 THEN 'needs more evidence' WHEN 3 THEN 'bogus' WHEN 4 THEN 'rejected' ELSE 'accepted with changes' END AS status, c_custkey%6=0 AS blank, c_custkey%10=1 AS badtime, c_custkey%14=5 AS drift, c_custkey%15=1 AS nounit FROM customer)"""


@query("review_compile", f"""WITH {_REVIEWS}, f AS (SELECT proposal_id, blank, concat_ws(',', CASE WHEN status IN ('accepted','accepted with changes') AND nounit THEN 'accepted_spatial_unit' END, CASE WHEN status='bogus' THEN 'status_value' END, CASE WHEN badtime THEN 'reviewed_at_value' END, CASE WHEN drift THEN 'evidence_heat_measure' END) AS fl FROM rvw)
    SELECT proposal_id, CASE WHEN blank THEN 'pending' WHEN fl<>'' THEN 'invalid' ELSE 'completed' END AS state, CASE WHEN blank THEN '' ELSE fl END AS failed FROM f""")
def review_compile(t):
    k = F.col("c_custkey")
    filled = k % 6 != 0
    say = lambda value: F.when(filled, value).otherwise("")
    status = F.when(k % 6 == 1, "accepted").when(k % 6 == 2, "needs more evidence").when(k % 6 == 3, "bogus").when(k % 6 == 4, "rejected").when(k % 6 == 5, "accepted with changes").otherwise("")
    base = t.customer.select(F.concat(F.lit("p"), k.cast("string")).alias("proposal_id"), "c_custkey", F.concat(F.lit("heat "), F.col("c_mktsegment")).alias("heat_measure"))
    reviews = base.select(
        "proposal_id", F.when(k % 14 == 5, "older heat").otherwise(F.col("heat_measure")).alias("heat_measure"), status.alias("review_status"), say(F.lit("reviewer")).alias("reviewer_name"),
        say(F.lit("owner")).alias("reviewer_role"), say(F.when(k % 10 == 1, "yesterday").otherwise("2026-10-16T13:41:13+02:00")).alias("reviewed_at"), say(F.lit("none")).alias("false_positive_preference"),
        say(F.lit("two sources")).alias("evidence_threshold"), say(F.lit("notes")).alias("review_notes"), say(F.lit("question")).alias("accepted_decision_question"),
        say(F.when(k % 15 == 1, " ").otherwise("tree")).alias("accepted_spatial_unit"), say(F.lit("distance")).alias("accepted_mobility_measure"), say(F.lit("summer")).alias("accepted_heat_period"))
    return quality.review_compile(reviews, base, ["heat_measure"])


@query("dq_recompute_site_flow", sql("sites slots4", f"""{MIXED}, {_MIXED_FLOW}, {_SITE_STATION}, sfx AS (SELECT ss.id, ord, nearest_station, CASE WHEN coalesce(measured,false) THEN mean_all END AS flow_mean, coalesce(measured,false) AS has_flow FROM ss JOIN sites USING (id) LEFT JOIN flow ON nearest_station=feature)
    SELECT 'not_stored' AS rule, id AS key FROM sfx WHERE ord%23=0 UNION ALL SELECT 'flow_mean', id FROM sfx WHERE ord%23>0 AND ord%17=0 AND flow_mean IS NOT NULL UNION ALL SELECT 'has_flow', id FROM sfx WHERE ord%23>0 AND ord%19=0
    UNION ALL SELECT 'unmeasured_station', feature FROM flow WHERE NOT measured AND feature<'f'"""))
def dq_recompute_site_flow(t):
    """Site rows against the flow of their station, and the list of unmeasured stations."""
    summary = materialise(flow_summary(mixed_slots(t)), "flow")
    fresh = series.flow_context(site_station(t), summary)
    at = fresh.join(t.views.sites.select("id", "ord"), "id")
    stored = at.where("ord % 23 > 0").withColumns({"flow_mean": F.col("flow_mean") + F.when(F.col("ord") % 17 == 0, 1).otherwise(0), "has_flow": F.when(F.col("ord") % 19 == 0, ~F.col("has_flow")).otherwise(F.col("has_flow"))})
    rows = quality.compare_tables(stored, fresh, ["id"], {"flow_mean": 1e-9, "has_flow": None})
    unmeasured = summary.where("not measured").select("feature")
    listed = keyed.id_set_equality(unmeasured.where("feature >= 'f'"), unmeasured, "feature")
    return rows.unionByName(listed.select(F.lit("unmeasured_station").alias("rule"), F.col("feature").alias("key")))


@query("dq_recompute_year_histogram", sql("incidents", """h AS (SELECT yr, count(*) AS n, count(*) FILTER (WHERE flagged) AS f FROM incidents GROUP BY yr)
    SELECT 'not_stored' AS rule, min(yr) AS key FROM h UNION ALL SELECT 'n', yr FROM h WHERE cast(yr AS int)%2=1 AND yr>(SELECT min(yr) FROM h) UNION ALL SELECT 'f', max(yr) FROM h UNION ALL SELECT 'not_recomputed', '1900' FROM (SELECT count(*) AS c FROM h) WHERE c>0"""))
def dq_recompute_year_histogram(t):
    """Stored incidents per year against a fresh count: a lost year, an invented one and wrong numbers."""
    fresh = materialise(t.views.incidents.groupBy("yr").agg(F.count("*").alias("n"), F.count_if("flagged").alias("f")), "years")
    ends = fresh.agg(F.struct(F.min("yr").alias("lo"), F.max("yr").alias("hi")).alias("e")).scalar()
    marked = fresh.withColumn("e", ends)
    stored = marked.where(F.col("yr") > F.col("e.lo")).select("yr", (F.col("n") + F.col("yr").cast("int") % 2).alias("n"), (F.col("f") + F.when(F.col("yr") == F.col("e.hi"), 1).otherwise(0)).alias("f"))
    invented = fresh.agg(F.lit("1900").alias("yr"), F.count("*").alias("n"), F.count("*").alias("f"))
    return quality.compare_tables(stored.unionByName(invented), fresh, ["yr"], {"n": None, "f": None})


@query("dq_recompute_region", sql("cube5", f"""{CUBE_METRICS}, g AS (SELECT count(*) AS n, max(seasonal_mean)-min(seasonal_mean) AS s FROM cube_m) SELECT 'cells' AS rule, 'region' AS key FROM g WHERE n>0 UNION ALL SELECT 'percentile_mean', 'region' FROM g WHERE n>0"""))
def dq_recompute_region(t):
    """The stored summary of a region, its extremes and spreads included, against a fresh one."""
    fresh = materialise(regions.region_summary(cube_metrics(t)).withColumn("scope", F.lit("region")), "region")
    stored = fresh.withColumns({"cells": F.col("cells") + 1, "percentile_mean": F.col("percentile_mean") - 0.5})
    measures = {c: None if c == "cells" else 1e-9 for c in fresh.columns if c != "scope"}
    return quality.compare_tables(stored, fresh, ["scope"], measures)
