"""Queries that score, rank and compare rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.functions.numbers import chance_overlap, rounded
from terrascreen.operators import compare, scoring
from terrascreen.operators.ordering import materialise, top_k
from terrascreen.plans.joins import NEAREST, nearest
from terrascreen.plans.registry import query
from terrascreen.plans.views import rnd, sql

_SCALE = "(CASE WHEN {hi}={lo} THEN 50.0 ELSE ({v}-{lo})/({hi}-{lo})*100 END)"
SCORED = f"""{NEAREST}, ex AS (SELECT min(heat_pixel) AS h0, max(heat_pixel) AS h1, min(distance_m) AS d0, max(distance_m) AS d1 FROM near),
 scored AS (SELECT near.*, {rnd(_SCALE.format(v='heat_pixel', lo='h0', hi='h1'), 3)} AS heat_score, {rnd('100-' + _SCALE.format(v='distance_m', lo='d0', hi='d1'), 3)} AS proximity_score FROM near, ex)"""
SIGNAL = rnd("heat_score*0.6::double+proximity_score*0.4::double", 3)


def scored(t):
    """Scored sites, written once: extremes, quantiles and rankings all read them."""
    return materialise(scoring.minmax_score(materialise(nearest(t), "nearest")), "scored")


@query("minmax_score", sql("sites stations", f"{SCORED} SELECT id, heat_score, proximity_score FROM scored"))
def minmax_score(t):
    return scoring.minmax_score(materialise(nearest(t), "nearest")).select("id", "heat_score", "proximity_score")


@query("ranked_screen", sql("sites stations", f"{SCORED} SELECT id, nearest_station, distance_m, heat_score, proximity_score, {SIGNAL} AS signal FROM scored ORDER BY signal DESC, id"))
def ranked_screen(t):
    screen = scoring.ranked_screen(scoring.minmax_score(materialise(nearest(t), "nearest")))
    return screen.select("id", "nearest_station", "distance_m", "heat_score", "proximity_score", "signal").orderBy(F.desc("signal"), "id")


_SCEN = f"""sc(scenario,wh,wp) AS (VALUES ('heat_only',1.0::double,0.0::double),('balanced',0.6::double,0.4::double),('proximity_only',0.0::double,1.0::double)),
 sg AS (SELECT scenario, id, {rnd('heat_score*wh+proximity_score*wp', 3)} AS signal FROM scored, sc),
 tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY signal DESC, id) AS rank FROM sg) WHERE rank<=10),
 ov AS (SELECT scenario, count(*) FILTER (WHERE id IN (SELECT id FROM tp WHERE scenario='balanced')) AS overlap FROM tp GROUP BY scenario)"""


@query("weight_scenarios", sql("sites stations", f"{SCORED}, {_SCEN} SELECT scenario, id, cast(rank AS bigint) AS rank, signal, cast(overlap AS bigint) AS overlap, overlap<5 AS material_change FROM tp JOIN ov USING (scenario)"))
def weight_scenarios(t):
    tops = materialise(scoring.weight_scenarios(scored(t)), "tops")
    return tops.join(scoring.scenario_overlaps(tops), "scenario").select("scenario", "id", F.col("rank").cast("bigint").alias("rank"), "signal", "overlap", "material_change")


@query("top_k_exact", """SELECT o_orderkey AS id, o_totalprice, cast(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rank FROM orders QUALIFY rank<=25""")
def top_k_exact(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return top_k(rows, [], [F.desc("o_totalprice"), F.col("id")], 25).withColumn("rank", F.col("rank").cast("bigint"))


@query("top_k_inclusive", """WITH c AS (SELECT min(l_quantity) AS cutoff FROM (SELECT l_quantity FROM lineitem ORDER BY l_quantity DESC LIMIT 100))
    SELECT l_orderkey AS id, l_linenumber, l_partkey, l_quantity, cutoff FROM lineitem, c WHERE l_quantity>=cutoff""")
def top_k_inclusive(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_quantity")
    return scoring.top_k_inclusive(rows, "l_quantity", 100)


@query("midranks", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rank() OVER (ORDER BY l_extendedprice DESC) + (count(*) OVER (PARTITION BY l_extendedprice) - 1)/2.0 AS midrank FROM lineitem""")
def midranks(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return scoring.midranks(rows, [], "l_extendedprice")


@query("high_high_quadrant", sql("sites stations", f"""{SCORED}, q AS (SELECT quantile_cont(heat_score,0.75) AS h, quantile_cont(proximity_score,0.75) AS p FROM scored)
    SELECT id, heat_score>=h AND proximity_score>=p AS high_high FROM scored, q"""))
def high_high_quadrant(t):
    return scoring.quadrant(scored(t)).select("id", "high_high")


@query("group_context", sql("sites stations", f"""{SCORED}, q AS (SELECT quantile_cont(heat_score,0.75) AS h, quantile_cont(proximity_score,0.75) AS p FROM scored)
    SELECT coalesce(district,'Unknown') AS district, cast(count(*) AS bigint) AS points, {rnd('avg(heat_pixel)', 6)} AS mean_heat, {rnd('median(distance_m)', 6)} AS median_distance,
    cast(count(*) FILTER (WHERE heat_score>=h AND proximity_score>=p) AS bigint) AS high_high FROM scored, q GROUP BY 1"""))
def group_context(t):
    context = scoring.group_context(scored(t))
    return context.select("district", "points", rounded("mean_heat", 6).alias("mean_heat"), rounded("median_distance", 6).alias("median_distance"), "high_high").orderBy(F.desc("points"), "district")


@query("sample_summary", sql("sites stations", f"""{SCORED} SELECT cast(count(*) AS bigint) AS points, min(heat_pixel) AS heat_min, max(heat_pixel) AS heat_max, cast(count(*) FILTER (WHERE heat_pixel<>0) AS bigint) AS heat_usable,
    {rnd('min(distance_m)', 1)} AS distance_min, {rnd('max(distance_m)', 1)} AS distance_max, {rnd('median(heat_pixel)', 1)} AS heat_median, {rnd('median(distance_m)', 1)} AS distance_median,
    {rnd('100.0*count(*)/(SELECT count(*) FROM orders)', 2)} AS share_of_register FROM scored"""))
def sample_summary(t):
    return scoring.sample_summary(scored(t), t.orders.agg(F.count("*")).scalar())


@query("field_completeness", sql("sites", """SELECT 'latitude' AS field, cast(count(latitude) AS bigint) AS present FROM sites UNION ALL SELECT 'longitude', count(longitude) FROM sites
    UNION ALL SELECT 'street', count(street) FROM sites UNION ALL SELECT 'district', count(district) FROM sites"""))
def field_completeness(t):
    return scoring.completeness(t.views.sites, ["latitude", "longitude", "street", "district"])


# --- site and cell panel ----------------------------------------------------------------------
PANEL = f"""cellm AS (SELECT (l_partkey*l_partkey) % 997 AS cell, {rnd('avg(l_quantity)', 2)} AS reference, {rnd('avg(l_extendedprice)/1000', 2)} AS seasonal, {rnd('avg(l_discount)*100', 2)} AS p90, {rnd('avg(l_tax)*100', 2)} AS hot FROM lineitem GROUP BY 1),
 panel AS (SELECT id, coalesce(district,'Unknown') AS district, (ord*ord) % 997 AS cell, heat_pixel::double AS fine, reference, seasonal, p90, hot FROM sites JOIN cellm ON cellm.cell=(ord*ord) % 997),
 cells AS (SELECT cell, count(*) AS members, avg(fine) AS fine_mean, min(fine) AS fine_min, max(fine) AS fine_max, min(reference) AS reference, min(seasonal) AS seasonal, min(p90) AS p90, min(hot) AS hot FROM panel GROUP BY cell)"""
METRICS = ["reference", "seasonal", "p90", "hot"]


def panel(t):
    """Sites with the metrics of their cell, written once for the comparisons that follow."""
    cells = t.lineitem.groupBy(((F.col("l_partkey") * F.col("l_partkey")) % 997).alias("cell")).agg(
        rounded(F.avg("l_quantity"), 2).alias("reference"), rounded(F.avg("l_extendedprice") / 1000, 2).alias("seasonal"),
        rounded(F.avg("l_discount") * 100, 2).alias("p90"), rounded(F.avg("l_tax") * 100, 2).alias("hot"))
    sites = t.views.sites.select("id", F.coalesce("district", F.lit("Unknown")).alias("district"), ((F.col("ord") * F.col("ord")) % 997).alias("cell"), F.col("heat_pixel").cast("double").alias("fine"))
    return materialise(sites.join(cells, "cell"), "panel")


def cmp_sql(source: str, keys: str, out: str, item: str = "id") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    pre = f"{keys}, " if keys else ""
    return f"""{out}w AS (SELECT *, row_number() OVER ({part} ORDER BY a DESC, {item}) AS pa, row_number() OVER ({part} ORDER BY b DESC, {item}) AS pb, rank() OVER ({part} ORDER BY a DESC) AS la, rank() OVER ({part} ORDER BY b DESC) AS lb,
  count(*) OVER (PARTITION BY {pre}a) AS ca, count(*) OVER (PARTITION BY {pre}b) AS cb FROM {source}),
 {out} AS (SELECT {pre}cast(count(*) AS bigint) AS n, cast(max(k) AS bigint) AS k, CASE WHEN min(a)=max(a) OR min(b)=max(b) THEN NULL ELSE {rnd('corr(la+(ca-1)/2.0, lb+(cb-1)/2.0)', 9)} END AS spearman,
  cast(count(*) FILTER (WHERE pa<=k AND pb<=k) AS bigint) AS exact_overlap, cast(count(*) FILTER (WHERE la<=k AND lb<=k) AS bigint) AS inclusive_overlap, min(a) FILTER (WHERE la<=k) AS left_cutoff, min(b) FILTER (WHERE lb<=k) AS right_cutoff,
  cast(count(*) FILTER (WHERE la<=k) AS bigint) AS left_inclusive, cast(count(*) FILTER (WHERE lb<=k) AS bigint) AS right_inclusive, {rnd('count(*) FILTER (WHERE la<=k AND lb<=k)/count(*) FILTER (WHERE la<=k OR lb<=k)', 9)} AS inclusive_jaccard FROM {out}w {'GROUP BY ' + keys if keys else ''})"""


def _tidy(df, *names):
    fixed = df.withColumns({"spearman": rounded("spearman", 9), "inclusive_jaccard": rounded("inclusive_jaccard", 9)})
    for name in ("left_cutoff", "right_cutoff"):
        fixed = fixed.withColumn(name, rounded(name, 6))
    return fixed.select(*names, "n", "k", "spearman", "exact_overlap", "inclusive_overlap", "left_cutoff", "right_cutoff", "left_inclusive", "right_inclusive", "inclusive_jaccard")


_CMP = "n, k, spearman, exact_overlap, inclusive_overlap, " + rnd("left_cutoff", 6) + " AS left_cutoff, " + rnd("right_cutoff", 6) + " AS right_cutoff, left_inclusive, right_inclusive, inclusive_jaccard"


@query("rank_comparison", sql("sites", f"{PANEL}, s AS (SELECT id, fine AS a, seasonal AS b, least(10,(SELECT count(*) FROM panel)) AS k FROM panel), {cmp_sql('s', '', 'c')} SELECT {_CMP} FROM c"))
def rank_comparison(t):
    rows = panel(t)
    k = F.least(F.lit(10), rows.agg(F.count("*")).scalar())
    return _tidy(compare.compare_rankings(rows.select("id", F.col("fine").alias("a"), F.col("seasonal").alias("b"), k.alias("k")), []))


_UNPIVOT = " UNION ALL ".join(f"SELECT 'site' AS unit, '{m}' AS metric, id AS item, fine AS a, {m} AS b, least(10,(SELECT count(*) FROM panel)) AS k FROM panel UNION ALL SELECT 'cell', '{m}', lpad(cast(cell AS varchar),6,'0'), fine_mean, {m}, greatest(1, cast(ceil((SELECT count(*) FROM cells)/4.0) AS bigint)) FROM cells" for m in METRICS)


@query("metric_matrix", sql("sites", f"{PANEL}, u AS ({_UNPIVOT}), {cmp_sql('u', 'unit, metric', 'c', 'item')} SELECT unit, metric, {_CMP} FROM c"))
def metric_matrix(t):
    rows = panel(t)
    cells = compare.cell_rollup(rows, METRICS)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("b")) for m in METRICS])).alias("p")
    site_k = F.least(F.lit(10), rows.agg(F.count("*")).scalar())
    sites = rows.select(F.lit("site").alias("unit"), F.col("id").alias("item"), F.col("fine").alias("a"), site_k.cast("bigint").alias("k"), pairs)
    cell_k = compare.selection_k(rows.agg(F.countDistinct("cell")).scalar(), 25)
    by_cell = cells.select(F.lit("cell").alias("unit"), F.lpad(F.col("cell").cast("string"), 6, "0").alias("item"), F.col("fine_mean").alias("a"), cell_k.alias("k"), pairs)
    long = sites.unionByName(by_cell).select("unit", "item", "a", "k", "p.metric", "p.b")
    return _tidy(compare.compare_rankings(long, ["unit", "metric"], "item"), "unit", "metric")


@query("threshold_sweep", sql("sites", f"""{PANEL}, s AS (SELECT percentage, id, fine AS a, seasonal AS b, greatest(1, cast(ceil((SELECT count(*) FROM panel)*percentage/100.0) AS bigint)) AS k FROM panel, (VALUES (10),(20),(25),(33),(50)) v(percentage)), {cmp_sql('s', 'percentage', 'c')} SELECT percentage, {_CMP} FROM c"""))
def threshold_sweep(t):
    return _tidy(compare.threshold_sweep(panel(t), "fine", "seasonal"), "percentage")


_ROUND = " UNION ALL ".join(f"SELECT {d} AS digits, cell, fine_mean, {rnd('reference', d)} AS r, {rnd('seasonal', d)} AS s FROM cells" for d in (2, 1, 0))


@query("rounding_sweep", sql("sites", f"""{PANEL}, g AS ({_ROUND}), kk AS (SELECT greatest(1, cast(ceil(count(*)*25/100.0) AS bigint)) AS k FROM cells),
    s AS (SELECT digits, 'fine_vs_seasonal' AS pair, cell AS id, fine_mean AS a, s AS b, k FROM g, kk UNION ALL SELECT digits, 'reference_vs_seasonal', cell, r, s, k FROM g, kk),
    d AS (SELECT digits, count(DISTINCT r) AS reference_distinct, count(DISTINCT s) AS seasonal_distinct FROM g GROUP BY 1), {cmp_sql('s', 'digits, pair', 'c')} SELECT digits, pair, reference_distinct, seasonal_distinct, {_CMP} FROM c JOIN d USING (digits)"""))
def rounding_sweep(t):
    cells = compare.cell_rollup(panel(t), METRICS)
    return _tidy(compare.rounding_sweep(cells), "digits", "pair", "reference_distinct", "seasonal_distinct")


def _variance_sql(source: str, key: str, equal: bool, out: str) -> str:
    w = "1.0" if equal else "n"
    return f"""{out}c AS (SELECT {key}, cell, count(*) AS n, avg(fine) AS m, var_pop(fine) AS v FROM {source} GROUP BY 1,2), {out}g AS (SELECT {key}, sum({w}) AS w, sum({w}*m)/sum({w}) AS g FROM {out}c GROUP BY 1),
 {out} AS (SELECT {key}, sum({w}*v)/max(w) AS within, sum({w}*(m-g)*(m-g))/max(w) AS between_v FROM {out}c JOIN {out}g USING ({key}) GROUP BY 1)"""


@query("coverage_sweep", sql("sites", f"""{PANEL}, th(minimum_members) AS (VALUES (1),(2),(3)), sc AS (SELECT minimum_members, cells.*, members>=minimum_members AS kept FROM cells, th),
    ct AS (SELECT minimum_members, coalesce(sum(members) FILTER (WHERE kept),0) AS sites, count(*) FILTER (WHERE kept) AS cells, coalesce(sum(members) FILTER (WHERE NOT kept),0) AS excluded_sites, count(*) FILTER (WHERE NOT kept) AS excluded_cells FROM sc GROUP BY 1),
    s AS (SELECT minimum_members, 'fine' AS pair, cell AS id, fine_mean AS a, seasonal AS b, greatest(1,cast(ceil(ct.cells*25/100.0) AS bigint)) AS k FROM sc JOIN ct USING (minimum_members) WHERE kept UNION ALL SELECT minimum_members, 'reference', cell, reference, seasonal, greatest(1,cast(ceil(ct.cells*25/100.0) AS bigint)) FROM sc JOIN ct USING (minimum_members) WHERE kept),
    {cmp_sql('s', 'minimum_members, pair', 'c')}, mem AS (SELECT minimum_members, p.cell, p.fine FROM panel p JOIN sc USING (cell) WHERE kept), {_variance_sql('mem', 'minimum_members', True, 'e')}, {_variance_sql('mem', 'minimum_members', False, 'x')}
    SELECT ct.minimum_members, cast(sites AS bigint) AS sites, cast(cells AS bigint) AS cells, cast(excluded_sites AS bigint) AS excluded_sites, cast(excluded_cells AS bigint) AS excluded_cells, f.k, f.spearman AS fine_spearman, f.exact_overlap AS fine_exact_overlap, f.inclusive_jaccard AS fine_inclusive_jaccard,
    r.spearman AS reference_spearman, r.exact_overlap AS reference_exact_overlap, r.inclusive_jaccard AS reference_inclusive_jaccard, {rnd('e.within/(e.within+e.between_v)', 9)} AS equal_cell_within, {rnd('x.within/(x.within+x.between_v)', 9)} AS weighted_within
    FROM ct LEFT JOIN (SELECT * FROM c WHERE pair='fine') f USING (minimum_members) LEFT JOIN (SELECT * FROM c WHERE pair='reference') r USING (minimum_members) LEFT JOIN e USING (minimum_members) LEFT JOIN x USING (minimum_members)"""))
def coverage_sweep(t):
    table = compare.coverage_sweep(panel(t))
    fractional = ("spearman", "jaccard", "within")
    return table.select(*[rounded(c, 9).alias(c) if c.endswith(fractional) else F.col(c) for c in table.columns])


@query("leave_one_group_out", sql("sites", f"""{PANEL}, o AS (SELECT DISTINCT district AS omitted FROM panel), rr AS (SELECT omitted, cell AS id, count(*) AS n, avg(fine) AS a, min(seasonal) AS b FROM panel, o WHERE district<>omitted GROUP BY 1,2),
    sz AS (SELECT omitted, count(*) AS c, sum(n) AS sites FROM rr GROUP BY 1), s AS (SELECT omitted, id, a, b, greatest(1,cast(ceil(c*25/100.0) AS bigint)) AS k FROM rr JOIN sz USING (omitted)), {cmp_sql('s', 'omitted', 'c')} SELECT omitted, cast(sites AS bigint) AS sites, {_CMP} FROM c JOIN sz USING (omitted)"""))
def leave_one_group_out(t):
    return _tidy(compare.leave_one_group_out(panel(t)), "omitted", "sites")


@query("cell_rollup", sql("sites", f"""{PANEL} SELECT cell, cast(members AS bigint) AS members, {rnd('fine_mean', 6)} AS fine_mean, fine_min, fine_max, reference, true AS unanimous FROM cells"""))
def cell_rollup(t):
    return compare.cell_rollup(panel(t), METRICS).select("cell", "members", rounded("fine_mean", 6).alias("fine_mean"), "fine_min", "fine_max", "reference", "unanimous")


@query("unanimous_value", sql("sites", f"""SELECT o_custkey AS grp, count(DISTINCT o_orderstatus)=1 AS unanimous, CASE WHEN count(DISTINCT o_orderstatus)=1 THEN min(o_orderstatus) END AS value FROM orders GROUP BY 1"""))
def unanimous_value(t):
    same = F.min("o_orderstatus") == F.max("o_orderstatus")
    return t.orders.groupBy(F.col("o_custkey").alias("grp")).agg(same.alias("unanimous"), F.when(same, F.min("o_orderstatus")).alias("value"))


@query("variance_partition", sql("sites", f"""{PANEL}, pp AS (SELECT 1 AS z, cell, fine FROM panel), {_variance_sql('pp', 'z', True, 'e')}, {_variance_sql('pp', 'z', False, 'x')},
    b AS (SELECT 'equal_cell' AS weights, within, between_v FROM e UNION ALL SELECT 'members', within, between_v FROM x)
    SELECT weights, {rnd('within', 6)} AS within, {rnd('between_v', 6)} AS "between", {rnd('within+between_v', 6)} AS total, {rnd('within/(within+between_v)', 9)} AS within_fraction FROM b"""))
def variance_partition(t):
    rows = panel(t)
    equal = compare.variance_partition(rows, [], equal_cells=True).withColumn("weights", F.lit("equal_cell"))
    both = equal.unionByName(compare.variance_partition(rows, []).withColumn("weights", F.lit("members")))
    return both.select("weights", *[rounded(c, 6).alias(c) for c in ("within", "between", "total")], rounded("within_fraction", 9).alias("within_fraction"))


@query("association", f"""WITH r AS (SELECT o_orderkey AS id, o_totalprice AS x, cast(o_custkey % 100 AS double) AS y FROM orders), k AS (SELECT *, rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2.0 AS rx, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0 AS ry FROM r)
    SELECT cast(count(*) AS bigint) AS n, {rnd('corr(x,y)', 9)} AS pearson, {rnd('corr(rx,ry)', 9)} AS spearman, cast(count(DISTINCT x) AS bigint) AS distinct_x, cast(count(DISTINCT y) AS bigint) AS distinct_y FROM k""")
def association(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"))
    return compare.association(rows, "x", "y")


_TOPS = " UNION ALL ".join(f"SELECT '{m}' AS metric, id, cell, {m}::double AS v FROM panel" for m in METRICS)
_TOPSETS = f"""um AS ({_TOPS} UNION ALL SELECT 'balanced', id, cell, {rnd('fine*0.6::double+seasonal*0.4::double', 3)} FROM panel), tt AS (SELECT metric, id, cell FROM um QUALIFY row_number() OVER (PARTITION BY metric ORDER BY v DESC, id)<=10)"""


def _top_sets(t):
    rows = panel(t)
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS]
    values.append(F.struct(F.lit("balanced").alias("metric"), rounded(F.col("fine") * 0.6 + F.col("seasonal") * 0.4, 3).alias("v")))
    long = rows.select("id", "cell", F.explode(F.array(*values)).alias("p")).select("id", "cell", "p.metric", "p.v")
    return materialise(top_k(long, ["metric"], [F.desc("v"), F.col("id")], 10), "top-sets")


@query("distinct_cells_in_top", sql("sites", f"{PANEL}, {_TOPSETS} SELECT metric, cast(count(DISTINCT cell) AS bigint) AS cells FROM tt WHERE metric<>'balanced' GROUP BY 1"))
def distinct_cells_in_top(t):
    return _top_sets(t).where("metric <> 'balanced'").groupBy("metric").agg(F.countDistinct("cell").alias("cells"))


_PAIRS = [(m, "balanced") for m in METRICS] + [(m, "reference") for m in METRICS[1:]]


@query("period_overlap", sql("sites", f"""{PANEL}, {_TOPSETS}, pr(l,r) AS (VALUES {', '.join(f"('{a}','{b}')" for a, b in _PAIRS)})
    SELECT l||'_vs_'||r AS pair, cast((SELECT count(*) FROM tt x JOIN tt y ON x.id=y.id WHERE x.metric=l AND y.metric=r) AS bigint) AS overlap FROM pr"""))
def period_overlap(t):
    tops = _top_sets(t)
    members = tops.groupBy("id").agg(F.collect_set("metric").alias("m"))  # at most five names per site
    counts = [F.count_if(F.array_contains("m", a) & F.array_contains("m", b)).alias(f"{a}_vs_{b}") for a, b in _PAIRS]
    wide = members.agg(*counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(f"{a}_vs_{b}").alias("overlap")) for a, b in _PAIRS])).alias("p")
    return wide.select(pairs).select("p.pair", "p.overlap")


@query("chance_top_k", f"""WITH c AS (SELECT o_orderkey, 50 + o_custkey % 150 AS n, 1 + o_orderkey % 20 AS k, o_orderkey % (2 + o_orderkey % 20) AS o FROM orders),
    x AS (SELECT c.*, unnest(generate_series(o, k)) AS i FROM c), y AS (SELECT o_orderkey, n, k, exp(lgamma(k+1)-lgamma(i+1)-lgamma(k-i+1) + lgamma(n-k+1)-lgamma(k-i+1)-lgamma(n-k-(k-i)+1) - (lgamma(n+1)-lgamma(k+1)-lgamma(n-k+1))) AS p FROM x)
    SELECT o_orderkey, {rnd('max(k*k/n::double)', 9)} AS expected, {rnd('least(sum(p),1.0)', 7)} AS probability FROM y GROUP BY 1""")
def chance_top_k(t):
    o = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", (50 + F.col("o_custkey") % 150).alias("n"), (1 + o % 20).alias("k"), (o % (2 + o % 20)).alias("o"))
    expected, probability = chance_overlap(F.col("n"), F.col("k"), F.col("o"))
    return rows.select("o_orderkey", rounded(expected, 9).alias("expected"), rounded(probability, 7).alias("probability"))


# --- mobility ---------------------------------------------------------------------------------
_SITE_FLOW = f"""ss AS (SELECT id, CASE ord%5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END AS station, heat_pixel::double AS heat_score, {rnd('heat_pixel*0.6::double + (ord%97)*0.4::double', 3)} AS signal FROM sites),
 dl AS (SELECT feature AS station, obs_day AS day, avg(cnt) AS flow, count(*) AS n FROM slots4 GROUP BY 1,2)"""


def _site_flow(t):
    kind = F.col("ord") % 5
    name = F.when(kind == 0, "click").when(kind == 1, "view").when(kind == 2, "error").when(kind == 3, "signup").otherwise("purchase")
    sites = t.views.sites.select("id", name.alias("station"), F.col("heat_pixel").cast("double").alias("heat_score"), rounded(F.col("heat_pixel") * 0.6 + (F.col("ord") % 97) * 0.4, 3).alias("signal"))
    daily = t.views.slots(4).groupBy(F.col("feature").alias("station"), F.col("obs_day").alias("day")).agg(F.avg("cnt").alias("flow"), F.count("*").alias("n"))
    return sites, daily


@query("mobility_alternatives", sql("sites slots4", f"""{_SITE_FLOW}, wk AS (SELECT station, sum(flow*n)/sum(n) AS flow FROM dl GROUP BY 1), al AS (SELECT station, cast(day AS varchar) AS variant, flow FROM dl UNION ALL SELECT station, 'window', flow FROM wk),
    b AS (SELECT variant, min(flow) AS lo, max(flow) AS hi FROM al GROUP BY 1), sc AS (SELECT variant, id, 0.6*heat_score + 0.4*(CASE WHEN hi=lo THEN 0 ELSE (flow-lo)/(hi-lo) END) AS score FROM ss JOIN al USING (station) JOIN b USING (variant)),
    tp AS (SELECT variant, id FROM sc QUALIFY row_number() OVER (PARTITION BY variant ORDER BY score DESC, id)<=10),
    wt AS (SELECT id, flow, heat_score FROM ss JOIN wk USING (station)), wb AS (SELECT min(flow) AS lo, max(flow) AS hi FROM wt), fl AS (SELECT 'flow_only' AS variant, id, flow AS score FROM wt UNION ALL SELECT 'weighted', id, 0.6*heat_score+0.4*(CASE WHEN hi=lo THEN 0 ELSE (flow-lo)/(hi-lo) END) FROM wt, wb),
    ft AS (SELECT variant, id FROM fl QUALIFY row_number() OVER (PARTITION BY variant ORDER BY score DESC, id)<=10), bt AS (SELECT id FROM ss ORDER BY signal DESC, id LIMIT 10)
    SELECT variant, cast(count(*) FILTER (WHERE id IN (SELECT id FROM tp WHERE variant='window')) AS bigint) AS overlap FROM tp GROUP BY 1 UNION ALL SELECT variant, cast(count(*) FILTER (WHERE id IN (SELECT id FROM bt)) AS bigint) FROM ft GROUP BY 1"""))
def mobility_alternatives(t):
    sites, daily = _site_flow(t)
    weekly = daily.groupBy("station").agg((F.sum(F.col("flow") * F.col("n")) / F.sum("n")).alias("flow"))
    return scoring.mobility_alternatives(sites.drop("signal"), daily).unionByName(scoring.flow_rankings(sites, weekly))
