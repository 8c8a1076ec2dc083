"""Queries over the scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.functions import geo, numbers, text
from terrascreen.operators.series import expected_grid
from terrascreen.plans.registry import query
from terrascreen.plans.views import haversine_sql, rnd, sql


@query("null_text", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_returnflag='N' THEN NULL ELSE l_linestatus END,'') AS status_text FROM lineitem")
def null_text(t):
    status = F.when(F.col("l_returnflag") != "N", F.col("l_linestatus"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.null_text(status).alias("status_text"))


_PROP = "regexp_extract(props, ': ([0-9]+)', 1)"


@query("to_number", f"""SELECT event_id, try_cast(CASE WHEN event_type='error' THEN props WHEN event_type='view' THEN ' '||{_PROP}||'.5 '
    WHEN event_type='click' THEN '' ELSE {_PROP} END AS double) AS number FROM events""")
def to_number(t):
    value = F.regexp_extract("props", ": ([0-9]+)", 1)
    raw = (F.when(F.col("event_type") == "error", F.col("props"))
           .when(F.col("event_type") == "view", F.concat(F.lit(" "), value, F.lit(".5 ")))
           .when(F.col("event_type") == "click", F.lit("")).otherwise(value))
    return t.events.select("event_id", text_number(raw).alias("number"))


def text_number(raw):
    return numbers.to_number(raw)


@query("is_finite", """SELECT c_custkey, (v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) AS finite FROM (
    SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 5 = 1 THEN 'nan'::double
    WHEN c_nationkey % 5 = 2 THEN 'infinity'::double ELSE c_acctbal END AS v FROM customer)""")
def is_finite(t):
    kind = F.col("c_nationkey") % 5
    value = (F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(float("nan")))
             .when(kind == 2, F.lit(float("inf"))).otherwise(F.col("c_acctbal")))
    return t.customer.select("c_custkey", numbers.is_finite(value).alias("finite"))


@query("first_present", """SELECT c_custkey, coalesce(CASE WHEN trim(a)<>'' THEN a END, CASE WHEN trim(b)<>'' THEN b END, CASE WHEN trim(c)<>'' THEN c END) AS chosen
    FROM (SELECT c_custkey, CASE WHEN c_custkey%4=0 THEN '  ' WHEN c_custkey%4=1 THEN NULL ELSE ' '||c_name END AS a,
    CASE WHEN c_custkey%3=0 THEN '' ELSE c_mktsegment END AS b, CASE WHEN c_custkey%24=0 THEN ' ' ELSE cast(c_nationkey AS varchar) END AS c FROM customer)""")
def first_present(t):
    key = F.col("c_custkey")
    a = F.when(key % 4 == 0, F.lit("  ")).when(key % 4 != 1, F.concat(F.lit(" "), F.col("c_name")))
    b = F.when(key % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    c = F.when(key % 24 == 0, F.lit(" ")).otherwise(F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", text.first_present(a, b, c).alias("chosen"))


@query("in_envelope", """SELECT o_orderkey, coalesce(lat BETWEEN 50.7 AND 51.0 AND lon BETWEEN 4.1 AND 4.7, false) AS inside FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey%11=0 THEN NULL ELSE cast(50.6::double + (o_orderkey%600)/1000.0 AS double) END AS lat, cast(4.0::double + (o_orderkey%900)/1000.0 AS double) AS lon FROM orders)""")
def in_envelope(t):
    key = F.col("o_orderkey")
    lat = F.when(key % 11 != 0, F.lit(50.6) + (key % 600) / 1000.0)
    return t.orders.select("o_orderkey", geo.in_envelope(lat, F.lit(4.0) + (key % 900) / 1000.0).alias("inside"))


@query("spreadsheet_safe", r"""SELECT doc_id, CASE WHEN regexp_matches(cell,'^[=+@\t\r-]') THEN ''''||cell ELSE cell END AS safe,
    regexp_matches(cell,'^[=+@\t\r-]') AS escaped, cell AS restored FROM (
    SELECT doc_id, CASE doc_id%7 WHEN 0 THEN '='||text WHEN 1 THEN '-'||text WHEN 2 THEN '@'||text WHEN 3 THEN '+'||text
    WHEN 4 THEN chr(9)||text WHEN 5 THEN '''='||text ELSE text END AS cell FROM documents)""")
def spreadsheet_safe(t):
    kind = F.col("doc_id") % 7
    lead = (F.when(kind == 0, "=").when(kind == 1, "-").when(kind == 2, "@").when(kind == 3, "+")
            .when(kind == 4, "\t").when(kind == 5, "'=").otherwise(""))
    cells = t.documents.select("doc_id", F.concat(lead, F.col("text")).alias("cell"))
    cells = cells.select("doc_id", "cell", text.spreadsheet_safe(F.col("cell")).alias("safe"), text.starts_formula(F.col("cell")).alias("escaped"))
    restored = F.when(F.col("escaped"), text.spreadsheet_unescape(F.col("safe"))).otherwise(F.col("safe"))
    return cells.select("doc_id", "safe", "escaped", restored.alias("restored"))


@query("parse_slash_date", """SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day_text FROM orders""")
def parse_slash_date(t):
    raw = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 00:15"))
    return t.orders.select("o_orderkey", text.parse_slash_date(raw).cast("string").alias("day_text"))


@query("is_iso8601", r"""SELECT event_id, (regexp_matches(v,'^\d{4}-\d{2}-\d{2}$') AND try_strptime(v,'%Y-%m-%d') IS NOT NULL)
    OR (regexp_matches(v,'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$') AND try_strptime(left(v,19),'%Y-%m-%dT%H:%M:%S') IS NOT NULL) AS valid
    FROM (SELECT event_id, CASE event_id%8 WHEN 0 THEN strftime(ts,'%Y-%m-%d') WHEN 1 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S')||'Z'
    WHEN 2 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S')||'.25+02:00' WHEN 3 THEN strftime(ts,'%Y/%m/%d') WHEN 4 THEN strftime(ts,'%Y-%m-31')
    WHEN 5 THEN strftime(ts,'%Y-13-%d') WHEN 6 THEN strftime(ts,'%Y-02-%dT%H:%M:%S') ELSE '' END AS v FROM events)""")
def is_iso8601(t):
    kind = F.col("event_id") % 8
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    value = (F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd")).when(kind == 1, F.concat(stamp, F.lit("Z")))
             .when(kind == 2, F.concat(stamp, F.lit(".25+02:00"))).when(kind == 3, F.date_format("ts", "yyyy/MM/dd"))
             .when(kind == 4, F.date_format("ts", "yyyy-MM-'31'")).when(kind == 5, F.date_format("ts", "yyyy-'13'-dd"))
             .when(kind == 6, F.date_format("ts", "yyyy-'02'-dd'T'HH:mm:ss")).otherwise(""))
    return t.events.select("event_id", text.is_iso8601(value).alias("valid"))


@query("is_season", """SELECT l_suppkey % 2 AS cell, year(l_shipdate) AS yr, cast(count(DISTINCT cast(l_shipdate AS date)) AS bigint) AS season_days,
    count(DISTINCT cast(l_shipdate AS date)) = 92 AS complete FROM lineitem WHERE month(l_shipdate) IN (6,7,8) GROUP BY 1,2""")
def is_season(t):
    return (t.lineitem.where(text.is_season(F.col("l_shipdate")))
            .groupBy((F.col("l_suppkey") % 2).alias("cell"), F.year("l_shipdate").cast("bigint").alias("yr"))
            .agg(F.countDistinct(F.to_date("l_shipdate")).alias("season_days"))
            .withColumn("complete", F.col("season_days") == 92))


@query("expected_calendar", sql("slots24", """b AS (SELECT min(obs_day) AS lo, max(obs_day) AS hi FROM slots24),
    d AS (SELECT cast(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date) AS obs_day FROM b), f AS (SELECT DISTINCT feature FROM slots24),
    g AS (SELECT feature, obs_day, s.slot FROM f, d, (SELECT unnest(generate_series(1,24)) AS slot) s)
    SELECT g.feature, cast(g.obs_day AS varchar) AS day_text, cast(g.slot AS int) AS slot, x.cnt IS NOT NULL AS present
    FROM g LEFT JOIN slots24 x ON g.feature=x.feature AND g.obs_day=x.obs_day AND g.slot=x.slot"""))
def expected_calendar(t):
    slots = t.views.slots(24)
    grid = expected_grid(slots, "feature", "obs_day", 24)
    joined = grid.join(slots, ["feature", "obs_day", "slot"], "left")
    return joined.select("feature", F.col("obs_day").cast("string").alias("day_text"), "slot", F.col("cnt").isNotNull().alias("present"))


@query("haversine_m", sql("sites", f"""SELECT id, {rnd(haversine_sql('latitude','longitude','50.85','4.35'),1)} AS distance_m FROM sites"""))
def haversine_m(t):
    d = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(50.85), F.lit(4.35))
    return t.views.sites.select("id", geo.rounded_metres(d).alias("distance_m"))


def _sql_linear(matrix, v):
    return [" + ".join(f"({row[i]!r})*{v[i]}" for i in range(3)) for row in matrix]


def _sql_ecef(lat, lon, a, f):
    e2 = f * (2 - f)
    r = f"({a!r}/sqrt(1-{e2!r}*sin({lat})*sin({lat})))"
    return [f"{r}*cos({lat})*cos({lon})", f"{r}*cos({lat})*sin({lon})", f"{r}*{1 - e2!r}*sin({lat})"]


def _sql_geodetic(source, keep, a, f, prefix):
    """CTE chain from columns px,py,pz to lat,lon in radians."""
    e2 = f * (2 - f)
    steps = [f"{prefix}0 AS (SELECT {keep}, pz, sqrt(px*px+py*py) AS h, atan2(py,px) AS lon, atan2(pz, sqrt(px*px+py*py)*{1 - e2!r}) AS lat FROM {source})"]
    for i in range(4):
        steps.append(f"{prefix}{i + 1} AS (SELECT {keep}, pz, h, lon, atan2(pz+{e2!r}*({a!r}/sqrt(1-{e2!r}*sin(lat)*sin(lat)))*sin(lat), h) AS lat FROM {prefix}{i})")
    return steps


def lambert_sql(source: str, keep: str = "id", prefix: str = "lm") -> str:
    """CTE chain ending in ``{prefix}xy`` with columns keep, x, y."""
    px, py, pz = _sql_ecef("radians(latitude)", "radians(longitude)", geo.WGS84_A, geo.WGS84_F)
    e = geo._INTL_E
    lin = _sql_linear(geo.inverse_3x3(geo.shift_matrix()), ["px", "py", "pz"])
    steps = [f"{prefix}e AS (SELECT {keep}, {px}-({geo.SHIFT_M[0]!r}) AS px, {py}-({geo.SHIFT_M[1]!r}) AS py, {pz}-({geo.SHIFT_M[2]!r}) AS pz FROM {source})",
             f"{prefix}m AS (SELECT {keep}, {lin[0]} AS px, {lin[1]} AS py, {lin[2]} AS pz FROM {prefix}e)"]
    steps += _sql_geodetic(f"{prefix}m", keep, geo.INTL_A, geo.INTL_F, f"{prefix}g")
    rho = f"{geo.CONE_SCALE!r}*pow(tan(pi()/4-lat/2)/pow((1-{e!r}*sin(lat))/(1+{e!r}*sin(lat)),{e / 2!r}),{geo.CONE_N!r})"
    steps.append(f"{prefix}r AS (SELECT {keep}, {rho} AS rho, {geo.CONE_N!r}*(lon-{geo.CONE_LON0!r}) AS theta FROM {prefix}g4)")
    steps.append(f"{prefix}xy AS (SELECT {keep}, {geo.CONE_X0!r}+rho*sin(theta) AS x, {geo.CONE_Y0 + geo.CONE_RHO0!r}-rho*cos(theta) AS y FROM {prefix}r)")
    return ", ".join(steps)


def wgs84_sql(source: str, keep: str = "id", prefix: str = "iv") -> str:
    """CTE chain ending in ``{prefix}ll`` with columns keep, latitude, longitude."""
    e = geo._INTL_E
    steps = [f"{prefix}d AS (SELECT {keep}, x-{geo.CONE_X0!r} AS dx, {geo.CONE_RHO0!r}-(y-{geo.CONE_Y0!r}) AS dy FROM {source})",
             f"{prefix}t AS (SELECT {keep}, pow(sqrt(dx*dx+dy*dy)/{geo.CONE_SCALE!r}, {1 / geo.CONE_N!r}) AS tv, {geo.CONE_LON0!r}+atan2(dx,dy)/{geo.CONE_N!r} AS lon FROM {prefix}d)",
             f"{prefix}p0 AS (SELECT *, pi()/2-2*atan(tv) AS lat FROM {prefix}t)"]
    for i in range(7):
        steps.append(f"{prefix}p{i + 1} AS (SELECT {keep}, tv, lon, pi()/2-2*atan(tv*pow((1-{e!r}*sin(lat))/(1+{e!r}*sin(lat)),{e / 2!r})) AS lat FROM {prefix}p{i})")
    px, py, pz = _sql_ecef("lat", "lon", geo.INTL_A, geo.INTL_F)
    steps.append(f"{prefix}e AS (SELECT {keep}, {px} AS ax, {py} AS ay, {pz} AS az FROM {prefix}p7)")
    lin = _sql_linear(geo.shift_matrix(), ["ax", "ay", "az"])
    steps.append(f"{prefix}w AS (SELECT {keep}, " + ", ".join(f"{part}+({s!r}) AS {n}" for part, s, n in zip(lin, geo.SHIFT_M, ("px", "py", "pz"))) + f" FROM {prefix}e)")
    steps += _sql_geodetic(f"{prefix}w", keep, geo.WGS84_A, geo.WGS84_F, f"{prefix}g")
    steps.append(f"{prefix}ll AS (SELECT {keep}, degrees(lat) AS latitude, degrees(lon) AS longitude FROM {prefix}g4)")
    return ", ".join(steps)


def laea_sql(source: str, keep: str = "id", prefix: str = "la") -> str:
    """CTE chain ending in ``{prefix}xy`` with columns keep, x, y."""
    e, e2 = geo._LAEA_E, geo.LAEA_E2
    s = "sin(radians(latitude))"
    q = f"{1 - e2!r}*({s}/(1-{e!r}*{s}*{e!r}*{s})-ln((1-{e!r}*{s})/(1+{e!r}*{s}))/{2 * e!r})"
    return (f"{prefix}b AS (SELECT {keep}, asin(({q})/{geo.LAEA_QP!r}) AS beta, radians(longitude-10.0) AS d FROM {source}), "
            f"{prefix}k AS (SELECT *, sqrt(2.0/(1+{geo.LAEA_SIN0!r}*sin(beta)+{geo.LAEA_COS0!r}*cos(beta)*cos(d))) AS k FROM {prefix}b), "
            f"{prefix}xy AS (SELECT {keep}, 4321000.0+{geo.LAEA_SCALE_X!r}*k*cos(beta)*sin(d) AS x, "
            f"3210000.0+{geo.LAEA_SCALE_Y!r}*k*({geo.LAEA_COS0!r}*sin(beta)-{geo.LAEA_SIN0!r}*cos(beta)*cos(d)) AS y FROM {prefix}k)")


@query("wgs84_to_lambert72", sql("sites", f"{lambert_sql('sites')} SELECT id, {rnd('x', 4)} AS x, {rnd('y', 4)} AS y FROM lmxy"))
def wgs84_to_lambert72(t):
    return geo.with_lambert72(t.views.sites).select("id", numbers.rounded("x", 4).alias("x"), numbers.rounded("y", 4).alias("y"))


_LAMBERT_POINTS = "SELECT o_orderkey AS id, 140000.0::double + (o_orderkey*7919) % 20000 AS x, 160000.0::double + (o_orderkey*15485) % 18000 AS y FROM orders"


@query("lambert72_to_wgs84", f"WITH p AS ({_LAMBERT_POINTS}), {wgs84_sql('p')} SELECT id, {rnd('latitude', 8)} AS latitude, {rnd('longitude', 8)} AS longitude FROM ivll")
def lambert72_to_wgs84(t):
    points = t.orders.select(F.col("o_orderkey").alias("id"), (140000.0 + (F.col("o_orderkey") * 7919) % 20000).alias("x"),
                             (160000.0 + (F.col("o_orderkey") * 15485) % 18000).alias("y"))
    return geo.with_wgs84(points).select("id", numbers.rounded("latitude", 8).alias("latitude"), numbers.rounded("longitude", 8).alias("longitude"))


@query("wgs84_to_laea", sql("sites", f"{laea_sql('sites')} SELECT id, {rnd('x', 4)} AS x, {rnd('y', 4)} AS y FROM laxy"))
def wgs84_to_laea(t):
    return geo.with_laea(t.views.sites).select("id", numbers.rounded("x", 4).alias("x"), numbers.rounded("y", 4).alias("y"))


@query("pixel_index", sql("sites", f"""{lambert_sql('sites')} SELECT id, cast(floor((x-140000.0)/2.0) AS bigint) AS col,
    cast(floor((178000.0-y)/2.0) AS bigint) AS row, (x >= 140000 AND x < 160000 AND y <= 178000 AND y > 160000) AS inside FROM lmxy"""))
def pixel_index(t):
    xy = geo.with_lambert72(t.views.sites)
    col, row = geo.pixel_index(F.col("x"), F.col("y"))
    return xy.select("id", col.alias("col"), row.alias("row")).withColumn("inside", geo.in_raster(F.col("col"), F.col("row")))


@query("grid_snap", sql("sites", """SELECT id, round_even(latitude/0.25,0)*0.25 AS grid_latitude, round_even(longitude/0.25,0)*0.25 AS grid_longitude FROM sites"""))
def grid_snap(t):
    return t.views.sites.select("id", geo.grid_snap(F.col("latitude")).alias("grid_latitude"), geo.grid_snap(F.col("longitude")).alias("grid_longitude"))


@query("nearest_axis_index", """WITH v AS (SELECT o_orderkey, 3900000.0::double + ((o_orderkey*37) % 31000) - 450 AS v FROM orders),
    i AS (SELECT o_orderkey, v, greatest(least(cast(ceil((v-3900000.0)/100.0-0.5) AS bigint),300),0) AS idx FROM v)
    SELECT o_orderkey, idx, abs(v-(3900000.0+idx*100.0)) <= 50.000001 AS inside FROM i""")
def nearest_axis_index(t):
    value = 3900000.0 + (F.col("o_orderkey") * 37) % 31000 - 450
    rows = t.orders.select("o_orderkey", value.alias("v"), geo.axis_index(value, 3900000.0, 100.0, 301).alias("idx"))
    offset = geo.axis_offset(F.col("v"), F.col("idx"), 3900000.0, 100.0)
    return rows.select("o_orderkey", "idx", geo.within_half_step(offset, 100.0).alias("inside"))


@query("map_position", sql("sites", f"""e AS (SELECT min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1 FROM sites)
    SELECT id, {rnd('1+(longitude-x0)/(x1-x0)*82', 6)} AS map_x, {rnd('83-(1+(latitude-y0)/(y1-y0)*82)', 6)} AS map_y FROM sites, e"""))
def map_position(t):
    sites = t.views.sites
    bounds = sites.agg(F.struct(F.min("longitude").alias("x0"), F.max("longitude").alias("x1"), F.min("latitude").alias("y0"), F.max("latitude").alias("y1")).alias("b"))
    placed = sites.withColumn("b", bounds.scalar())
    return placed.select(
        "id", numbers.rounded(geo.map_position(F.col("longitude"), F.col("b.x0"), F.col("b.x1")), 6).alias("map_x"),
        numbers.rounded(83 - geo.map_position(F.col("latitude"), F.col("b.y0"), F.col("b.y1")), 6).alias("map_y"))


@query("safe_weight", f"""WITH w AS (SELECT c_custkey, CASE WHEN c_custkey%10=0 THEN 'nan'::double WHEN c_custkey%10=1 THEN 'infinity'::double WHEN c_custkey%10=2 THEN 1e308 ELSE c_acctbal END AS a,
    CASE WHEN c_custkey%10<2 THEN 'infinity'::double WHEN c_custkey%10=2 THEN 1e308 ELSE cast(c_nationkey AS double) END AS b FROM customer),
    u AS (SELECT c_custkey, CASE WHEN isfinite(a) AND a>=0 THEN a ELSE 0.0::double END AS a, CASE WHEN isfinite(b) AND b>=0 THEN b ELSE 0.0::double END AS b FROM w)
    SELECT c_custkey, CASE WHEN greatest(a,b)=0 THEN 0.5::double ELSE {rnd('(a/greatest(a,b))/(a/greatest(a,b)+b/greatest(a,b))', 6)} END AS heat_weight,
    CASE WHEN greatest(a,b)=0 THEN 0.5::double ELSE {rnd('(b/greatest(a,b))/(a/greatest(a,b)+b/greatest(a,b))', 6)} END AS proximity_weight FROM u""")
def safe_weight(t):
    kind = F.col("c_custkey") % 10
    a = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind == 2, F.lit(1e308)).otherwise(F.col("c_acctbal"))
    b = F.when(kind < 2, F.lit(float("inf"))).when(kind == 2, F.lit(1e308)).otherwise(F.col("c_nationkey").cast("double"))
    raw = t.customer.select("c_custkey", a.alias("a"), b.alias("b"))
    first, second = numbers.weight_share(F.col("a"), F.col("b"))
    return raw.select("c_custkey", first.alias("heat_weight"), second.alias("proximity_weight"))


@query("publication_round", f"SELECT vec_id, {rnd('cast(embedding[1] AS double)/3', 12)} AS first_value, {rnd('cast(embedding[2] AS double)/7', 12)} AS second_value FROM embeddings")
def publication_round(t):
    e = lambda i: F.element_at("embedding", i).cast("double")
    return numbers.publication_round(t.embeddings.select("vec_id", (e(1) / 3).alias("first_value"), (e(2) / 7).alias("second_value")))


@query("required_sample_size", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount>0 AND l_quantity/51.0>0 AND l_quantity/51.0<1 AND 1+l_tax*10>=1 THEN
    cast(ceil((1+l_tax*10)*(3.8414588206941254*(l_quantity/51.0)*(1-l_quantity/51.0)/(l_discount*l_discount))) AS bigint) END AS points FROM lineitem""")
def required_sample_size(t):
    q = F.col("l_quantity") / 51.0
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             numbers.required_sample_size(F.col("l_discount"), q, 1 + F.col("l_tax") * 10).alias("points"))



@query("wilson_interval", f"""WITH c AS (SELECT o_orderkey, cast(1 + o_orderkey % 400 AS double) AS n, cast((o_custkey*7) % (2 + o_orderkey % 400) AS double) AS s FROM orders),
    w AS (SELECT o_orderkey, n, (s/n + 3.8414588206941254/(2*n))/(1+3.8414588206941254/n) AS centre,
    1.959963984540054*sqrt((s/n)*(1-s/n)/n + 3.8414588206941254/(4*n*n))/(1+3.8414588206941254/n) AS spread FROM c)
    SELECT o_orderkey, {rnd('greatest(0.0, centre-spread)', 9)} AS low, {rnd('least(1.0, centre+spread)', 9)} AS high FROM w""")
def wilson_interval(t):
    n = 1 + F.col("o_orderkey") % 400
    low, high = numbers.wilson_bounds((F.col("o_custkey") * 7) % (n + 1), n)
    return t.orders.select("o_orderkey", numbers.rounded(low, 9).alias("low"), numbers.rounded(high, 9).alias("high"))
