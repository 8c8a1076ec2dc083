"""Queries over slot and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded
from terrascreen.operators import compare, keyed, regions, series, states
from terrascreen.operators.ordering import materialise
from terrascreen.plans.comparisons import _CMP, _tidy, cmp_sql
from terrascreen.plans.joins import MIXED, _MIXED_FLOW, flow_sql, flow_summary, mixed_slots
from terrascreen.plans.registry import query
from terrascreen.plans.views import rnd, sql
from terrascreen.session import scratch_path

REFERENCE, HOT, TROPICAL = "1996-08-24", 27.0, 20.5
_FLOW_COLUMNS = "feature, days, observed_total, measured, reason, mean_all, min_day_mean, max_day_mean"


@query("slot_flow_summary", sql("slots4", f"{MIXED}, {_MIXED_FLOW} SELECT {_FLOW_COLUMNS} FROM flow"))
def slot_flow_summary(t):
    return flow_summary(mixed_slots(t))


@query("slot_flow_incomplete", sql("slots24", f"{flow_sql(24)} SELECT {_FLOW_COLUMNS} FROM flow"))
def slot_flow_incomplete(t):
    slots = t.views.slots(24)
    bounds = slots.agg(F.struct(F.min("obs_day").alias("lo"), F.max("obs_day").alias("hi")).alias("b")).scalar()
    return series.slot_flow_summary(slots, bounds["lo"], bounds["hi"], 24)


_GATED = "gs AS (SELECT feature, obs_day, slot, cnt, CASE WHEN feature='click' THEN -1.0 ELSE 10.0 END AS speed FROM mx)"


@query("slot_history_gate", sql("slots4", f"""{MIXED}, {_GATED}, b AS (SELECT min(obs_day) AS lo, max(obs_day) AS hi, date_diff('day',min(obs_day),max(obs_day))+1 AS nd FROM gs),
    d AS (SELECT feature, obs_day, count(*) AS n, count(DISTINCT slot) AS sl, sum(cnt) AS t, count(*) FILTER (WHERE speed>=0) AS sp FROM gs GROUP BY 1,2),
    w AS (SELECT feature, sum(n) AS n, count(*) AS days, count(*) FILTER (WHERE n<>4) AS bad, count(*) FILTER (WHERE sl<>4) AS bs, sum(t) AS t, sum(sp) AS sp FROM d GROUP BY 1)
    SELECT 'row_count' AS rule, feature AS key FROM w, b WHERE n<>nd*4 UNION ALL SELECT 'day_coverage', feature FROM w, b WHERE days<>nd UNION ALL SELECT 'rows_per_day', feature FROM w WHERE bad>0
    UNION ALL SELECT 'slot_set', feature FROM w WHERE bs>0 UNION ALL SELECT 'zero_total', feature FROM w WHERE t<1 UNION ALL SELECT 'no_speed', feature FROM w WHERE sp=0"""))
def slot_history_gate(t):
    slots = mixed_slots(t).withColumn("speed", F.when(F.col("feature") == "click", -1.0).otherwise(10.0))
    bounds = slots.agg(F.struct(F.min("obs_day").alias("lo"), F.max("obs_day").alias("hi")).alias("b")).scalar()
    return series.slot_history_gate(slots, bounds["lo"], bounds["hi"], 4)


@query("history_stats", sql("slots4", f"""{MIXED}, {_MIXED_FLOW} SELECT cast(count(*) AS bigint) AS observations, {rnd('avg(cnt)', 1)} AS mean_count, cast(round_even(max(cnt),0) AS bigint) AS max_count,
    cast((SELECT count(*) FROM flow WHERE measured) AS bigint) AS measured_features, cast((SELECT count(*) FROM flow WHERE NOT measured) AS bigint) AS unmeasured_features FROM mx WHERE feature IN (SELECT feature FROM flow WHERE measured)"""))
def history_stats(t):
    slots = mixed_slots(t)
    return series.history_stats(slots, flow_summary(slots))


@query("history_station_rows", sql("slots4", f"""{MIXED}, {_MIXED_FLOW} SELECT feature, CASE WHEN measured THEN mean_all END AS mean_all, CASE WHEN measured THEN min_day_mean END AS min_day_mean, CASE WHEN measured THEN max_day_mean END AS max_day_mean,
    CASE WHEN measured THEN cast(row_number() OVER (PARTITION BY measured ORDER BY mean_all DESC, feature) AS bigint) END AS place FROM flow"""))
def history_station_rows(t):
    return series.station_rows(flow_summary(mixed_slots(t)))


def season_sql(view: str, complete: bool = True) -> str:
    return f"""rf AS (SELECT cell, max(val) AS ref FROM {view} WHERE obs_day=DATE '{REFERENCE}' GROUP BY 1), se AS (SELECT c.*, year(obs_day) AS yr, ref FROM {view} c LEFT JOIN rf USING (cell) WHERE month(obs_day) IN (6,7,8)),
 ym AS (SELECT cell, yr, avg(val) AS m, sum(val) AS s, sum(low) AS sl, count(*) AS n, max(val) AS top, count(*) FILTER (WHERE val>={HOT}) AS hot, count(*) FILTER (WHERE low>={TROPICAL}) AS trop, CASE WHEN max(ref) IS NOT NULL THEN count(*) FILTER (WHERE val<ref) END AS below, max(ref) AS ref FROM se GROUP BY 1,2),
 sm AS (SELECT cell, cast(count(*) AS bigint) AS seasons, cast(sum(n) AS bigint) AS season_days, {rnd('sum(s)/sum(n)', 2)} AS seasonal_mean, {rnd('sum(sl)/sum(n)', 2)} AS seasonal_low_mean, {rnd('max(m)-min(m)', 2)} AS spread_across_years,
  cast(arg_min(yr, {{'a':-m,'b':yr}}) AS varchar) AS hottest_year, {rnd('max(m)', 2)} AS hottest_year_mean, {rnd('max(top)', 1)} AS warmest, {rnd('avg(hot)', 1)} AS hot_days_per_season, {rnd('avg(trop)', 1)} AS tropical_nights_per_season, {rnd('max(ref)', 1)} AS reference_value,
  {rnd('max(m) FILTER (WHERE yr=1996)', 2)} AS reference_season_mean, cast(max(below) FILTER (WHERE yr=1996)+1 AS bigint) AS reference_rank, {rnd('100.0*max(below) FILTER (WHERE yr=1996)/max(n) FILTER (WHERE yr=1996)', 1)} AS reference_percentile,
  {rnd('100.0*sum(below)/sum(n)', 1)} AS window_percentile FROM ym GROUP BY cell {'HAVING min(n)=92 AND max(n)=92' if complete else ''})"""


def _season(t):
    return series.season_metrics(t.views.cube(2), REFERENCE, HOT, TROPICAL)


@query("season_metrics", sql("cube2", f"{season_sql('cube2')} SELECT * FROM sm"))
def season_metrics(t):
    return _season(t)


CUBE_METRICS = f"""rf AS (SELECT cell, max(val) AS ref FROM cube5 WHERE obs_day=DATE '{REFERENCE}' GROUP BY 1), se AS (SELECT c.*, year(obs_day) AS yr, ref FROM cube5 c LEFT JOIN rf USING (cell) WHERE month(obs_day) IN (6,7,8)),
 ym AS (SELECT cell, yr, avg(val) AS m FROM se GROUP BY 1,2), hy AS (SELECT cell, count(*) AS seasons, cast(arg_min(yr, {{'a':-m,'b':yr}}) AS varchar) AS hottest_year, {rnd('max(m)', 2)} AS hottest_year_mean FROM ym GROUP BY 1),
 cm AS (SELECT cell, {rnd('max(ref)', 2)} AS reference_value, {rnd('avg(val)', 2)} AS seasonal_mean, {rnd('max(val)', 2)} AS seasonal_max, {rnd('quantile_disc(val,0.9)', 2)} AS seasonal_p90, {rnd('min(val)', 2)} AS seasonal_min, count(*) FILTER (WHERE val>={HOT}) AS hot,
  CASE WHEN max(ref) IS NOT NULL THEN cast(count(*) FILTER (WHERE val<ref)+1 AS bigint) END AS reference_rank, CASE WHEN max(ref) IS NOT NULL THEN {rnd('100.0*count(*) FILTER (WHERE val<ref)/count(*)', 1)} END AS reference_percentile FROM se GROUP BY 1),
 cube_m AS (SELECT cell, reference_value, seasonal_mean, seasonal_max, seasonal_p90, seasonal_min, {rnd('hot/seasons::double', 2)} AS hot_days_per_season, reference_rank, reference_percentile, hottest_year, hottest_year_mean FROM cm JOIN hy USING (cell))"""


def cube_metrics(t):
    return series.cube_season_metrics(t.views.cube(5), REFERENCE, HOT)


@query("cube_season_metrics", sql("cube5", f"{CUBE_METRICS} SELECT * FROM cube_m"))
def cube_season_metrics(t):
    return cube_metrics(t)


REGION = f"""SELECT cast(count(*) AS bigint) AS cells, min(reference_value) AS reference_min, max(reference_value) AS reference_max, {rnd('max(reference_value)-min(reference_value)', 2)} AS reference_spread, min(seasonal_mean) AS seasonal_min, max(seasonal_mean) AS seasonal_max,
 {rnd('max(seasonal_mean)-min(seasonal_mean)', 2)} AS seasonal_spread, min(hot_days_per_season) AS hot_days_min, max(hot_days_per_season) AS hot_days_max, min(reference_percentile) AS percentile_min, max(reference_percentile) AS percentile_max, {rnd('avg(reference_percentile)', 1)} AS percentile_mean"""


@query("region_summary", sql("cube5", f"{CUBE_METRICS} {REGION} FROM cube_m"))
def region_summary(t):
    return regions.region_summary(cube_metrics(t))


@query("season_context", sql("cube2", f"""{season_sql('cube2')} SELECT string_agg(DISTINCT hottest_year, ',' ORDER BY hottest_year) AS hottest_years, {rnd('avg(hottest_year_mean)', 2)} AS hottest_mean, {rnd('avg(reference_season_mean)', 2)} AS reference_season_mean,
    min(reference_rank) AS rank_min, max(reference_rank) AS rank_max, min(hot_days_per_season) AS hot_days_min, max(hot_days_per_season) AS hot_days_max FROM sm"""))
def season_context(t):
    return regions.season_context(_season(t))


@query("reference_rank", sql("cube5", f"""rf AS (SELECT cell, max(val) AS ref FROM cube5 WHERE obs_day=DATE '{REFERENCE}' GROUP BY 1) SELECT c.cell, year(obs_day) AS yr, cast(count(*) FILTER (WHERE val<ref)+1 AS bigint) AS rank,
    {rnd('100.0*count(*) FILTER (WHERE val<ref)/count(*)', 1)} AS percentile FROM cube5 c JOIN rf ON c.cell=rf.cell WHERE month(obs_day) IN (6,7,8) GROUP BY 1,2"""))
def reference_rank(t):
    return regions.reference_rank(t.views.cube(5), REFERENCE).withColumn("yr", F.col("yr").cast("bigint"))


@query("argmax_year", sql("cube5", f"""y AS (SELECT cell, year(obs_day) AS yr, avg(val) AS m FROM cube5 WHERE month(obs_day) IN (6,7,8) GROUP BY 1,2) SELECT cell, arg_min(yr, {{'a':-m,'b':yr}}) AS hottest_year, {rnd('max(m)', 6)} AS mean FROM y GROUP BY 1"""))
def argmax_year(t):
    return regions.argmax_year(t.views.cube(5)).withColumn("mean", rounded("mean", 6))


_MM = f"""mc AS (SELECT l_suppkey%25 AS cell, cast(l_shipdate AS date) AS obs_day, avg(l_quantity) AS v1, max(l_quantity) AS v2 FROM lineitem GROUP BY 1,2),
 mw AS (SELECT cell, max(v1) FILTER (WHERE obs_day=DATE '{REFERENCE}') AS mean_ref, max(v2) FILTER (WHERE obs_day=DATE '{REFERENCE}') AS max_ref, avg(v1) FILTER (WHERE month(obs_day) IN (6,7,8) AND year(obs_day)=1996) AS mean_season,
  avg(v2) FILTER (WHERE month(obs_day) IN (6,7,8) AND year(obs_day)=1996) AS max_season FROM mc GROUP BY 1 HAVING count(*) FILTER (WHERE obs_day=DATE '{REFERENCE}')>0)"""
_MM_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS comparison, cell AS id, {rnd(a, 6)} AS a, {rnd(b, 6)} AS b FROM mw" for n, (a, b) in regions.MEAN_MAX_PAIRS.items())


@query("mean_max_comparison", sql("", f"""{_MM}, r AS ({_MM_ROWS}), s AS (SELECT *, greatest(1,cast(ceil((SELECT count(*) FROM mw)*25/100.0) AS bigint)) AS k FROM r), {cmp_sql('s', 'comparison', 'c')} SELECT comparison, {_CMP} FROM c"""))
def mean_max_comparison(t):
    keys = [(F.col("l_suppkey") % 25).alias("cell"), F.to_date("l_shipdate").alias("obs_day")]
    first = t.lineitem.groupBy(*keys).agg(F.avg("l_quantity").alias("val"))
    second = t.lineitem.groupBy(*keys).agg(F.max("l_quantity").alias("val"))
    pairs, _ = keyed.paired_series(first, second, ["cell", "obs_day"])
    cells = materialise(regions.mean_max_cells(pairs, REFERENCE, 1996).where("mean_ref IS NOT NULL"), "cells")
    rows = regions.mean_max_pairs(cells).withColumns({"a": rounded("a", 6), "b": rounded("b", 6), "k": compare.selection_k(cells.agg(F.count("*")).scalar(), 25)})
    return _tidy(compare.compare_rankings(rows, ["comparison"], "cell"), "comparison")


_PACKED = """pk AS (SELECT l_suppkey % 7 AS cell, date_diff('day', DATE '1995-01-01', cast(l_shipdate AS date)) AS day_offset, cast(CASE WHEN l_quantity=50 THEN -9999 WHEN l_quantity=49 THEN -32768 ELSE l_quantity*10 END AS bigint) AS raw, l_orderkey, l_partkey, l_linenumber FROM lineitem)"""


def _packed(t):
    raw = F.when(F.col("l_quantity") == 50, -9999).when(F.col("l_quantity") == 49, -32768).otherwise((F.col("l_quantity") * 10).cast("bigint"))
    offset = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return t.lineitem.select((F.col("l_suppkey") % 7).alias("cell"), offset.alias("day_offset"), raw.alias("raw"), "l_orderkey", "l_partkey", "l_linenumber")


@query("decode_packed_cube", sql("", f"""{_PACKED} SELECT cell, l_orderkey, l_partkey, l_linenumber, CASE WHEN raw IN (-9999,-32768) THEN NULL ELSE {rnd('raw*0.01::double+5.5::double', 6)} END AS val FROM pk"""))
def decode_packed_cube(t):
    cube = regions.decode_cube(_packed(t), "days since 1995-01-01", [-9999, -32768], 0.01, 5.5)
    return cube.select("cell", "l_orderkey", "l_partkey", "l_linenumber", rounded("val", 6).alias("val"))


@query("decode_day_offsets", sql("", f"""{_PACKED}, d AS (SELECT cell, cast(DATE '1995-01-01' + cast(day_offset AS int) AS date) AS obs_day FROM pk GROUP BY 1,2), y AS (SELECT DISTINCT cell, year(obs_day) AS yr FROM d),
    f AS (SELECT cell, cast(unnest(generate_series(make_date(yr,1,1), make_date(yr,12,31), INTERVAL 1 DAY)) AS date) AS obs_day FROM y) SELECT f.cell, cast(f.obs_day AS varchar) AS day_text, 'missing' AS problem FROM f ANTI JOIN d ON f.cell=d.cell AND f.obs_day=d.obs_day"""))
def decode_day_offsets(t):
    cube = regions.decode_cube(_packed(t), "days since 1995-01-01", [-9999, -32768], 0.01, 5.5)
    gaps = regions.calendar_gaps(cube.select("cell", "obs_day").distinct(), ["cell"], "obs_day")
    return gaps.select("cell", F.col("obs_day").cast("string").alias("day_text"), "problem")


_YEARS = "yc AS (SELECT l_partkey % 200 AS col, l_suppkey % 3 AS row, cast(l_shipdate AS date) AS obs_day, year(l_shipdate) AS yr FROM lineitem)"


@query("pool_years", sql("", f"""{_YEARS}, g AS (SELECT col, row, count(DISTINCT yr) AS n FROM yc GROUP BY 1,2), ys AS (SELECT DISTINCT yr FROM yc), ex AS (SELECT unnest(generate_series(min(yr),max(yr))) AS y FROM ys),
    dd AS (SELECT col, row, obs_day FROM yc GROUP BY 1,2,3 HAVING count(*)>1) SELECT 'grid_differs' AS problem, col||':'||row AS key FROM g WHERE n<>(SELECT count(*) FROM ys) UNION ALL SELECT 'year_missing', cast(y AS varchar) FROM ex WHERE y NOT IN (SELECT yr FROM ys)
    UNION ALL SELECT 'duplicate_date', col||':'||row||':'||cast(obs_day AS varchar) FROM dd"""))
def pool_years(t):
    rows = t.lineitem.select((F.col("l_partkey") % 200).alias("col"), (F.col("l_suppkey") % 3).alias("row"), F.to_date("l_shipdate").alias("obs_day"), F.year("l_shipdate").alias("yr"))
    return regions.pool_problems(rows, ["col", "row"])


def _stored_states(t, daily):
    """All years but the last as one load, then the last one on its own, which reads nothing else."""
    path, daily = scratch_path(t.spark, "states"), materialise(daily.withColumn("yr", F.year("obs_day")), "daily")
    last = daily.agg(F.max("yr")).scalar()
    marked = daily.withColumn("_last", last)
    for part in ("yr < _last", "yr = _last"):
        states.store_states(states.season_states(marked.where(part).drop("yr", "_last"), REFERENCE, HOT, TROPICAL), path)
    return states.stored_states(t.spark, path)


@query("season_metrics_from_states", sql("cube2", f"{season_sql('cube2')} SELECT * FROM sm"))
def season_metrics_from_states(t):
    return states.season_metrics(_stored_states(t, t.views.cube(2)), int(REFERENCE[:4]))


@query("cube_season_metrics_from_states", sql("cube5", f"{CUBE_METRICS} SELECT * FROM cube_m"))
def cube_season_metrics_from_states(t):
    return states.cube_season_metrics(_stored_states(t, t.views.cube(5)))
