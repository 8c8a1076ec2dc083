"""Queries of the sampling and estimation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded
from terrascreen.operators import covers, survey
from terrascreen.operators.ordering import materialise
from terrascreen.plans.joins import _FRAME_LABELS, frame_labels
from terrascreen.plans.linear import _BUFFERED, GRID, SEGMENTS, _buffer_metrics
from terrascreen.plans.registry import query
from terrascreen.plans.views import rnd, sql

# Points, replicate draws and trials of the sampling study; the seed is our own.
TOTAL, DRAWS, TRIALS, SEED = 385, 4000, 400, 40127


def remainder_sql(source: str, weight: str, total: str, order: str, out: str) -> str:
    return f"""{out}e AS (SELECT *, {weight}*({total})::double/(SELECT sum({weight}) FROM {source}) AS ex FROM {source}),
 {out}r AS (SELECT *, row_number() OVER (ORDER BY ex-floor(ex) DESC, {weight} DESC, {order}) AS rk, ({total})-sum(floor(ex)) OVER () AS short FROM {out}e),
 {out} AS (SELECT * EXCLUDE (ex, rk, short), cast(floor(ex) + CASE WHEN rk<=short THEN 1 ELSE 0 END AS bigint) AS got FROM {out}r)"""


CELLS = f"""cc AS (SELECT stratum, gid, count(*) AS candidates, count(*)-1 AS spare FROM frame GROUP BY 1,2), {remainder_sql('cc', 'spare', f'{TOTAL}-(SELECT count(*) FROM cc)', 'stratum, gid', 'al')},
 cells AS (SELECT stratum, gid, candidates, got+1 AS allocated FROM al)"""
_U = f"((gid*7919 + length(stratum)*104729 + {SEED}) % 10007)/10007.0::double"
SAMPLE = f"""{CELLS}, pos AS (SELECT f.*, row_number() OVER (PARTITION BY stratum, gid ORDER BY chainage)-1 AS p FROM frame f),
 dr AS (SELECT stratum, gid, candidates, allocated, unnest(generate_series(0, allocated-1)) AS i FROM cells),
 dp AS (SELECT *, least(candidates-1, cast(floor({_U}*(candidates/allocated::double) + i*(candidates/allocated::double)) AS bigint)) AS p FROM dr),
 smp AS (SELECT pos.gid, pos.idx, pos.chainage, pos.stratum, candidates, allocated, {rnd('allocated/candidates::double', 8)} AS inclusion_probability, {rnd('candidates/allocated::double', 8)} AS weight FROM dp JOIN pos USING (stratum, gid, p))"""
LABELLED = f"""{SAMPLE}, pts AS (SELECT smp.*, CASE WHEN (idx*7+gid)%10<4 THEN 'canopy' WHEN (idx*7+gid)%10<9 THEN 'not_canopy' ELSE 'unknown' END AS label FROM smp)"""


def _fraction():
    return ((F.col("gid") * 7919 + F.length("stratum") * 104729 + SEED) % 10007) / F.lit(10007.0)


def _sample(t):
    return materialise(survey.systematic_sample(t.views.frame, TOTAL, _fraction()), "sample")


def _labelled(t):
    kind = (F.col("idx") * 7 + F.col("gid")) % 10
    return _sample(t).withColumn("label", F.when(kind < 4, "canopy").when(kind < 9, "not_canopy").otherwise("unknown"))


def _frame_size(t):
    return t.views.frame.agg(F.count("*")).scalar()


@query("largest_remainder", f"""WITH g AS (SELECT c_nationkey, count(*) AS w FROM customer GROUP BY 1), {remainder_sql('g', 'w', '997', 'c_nationkey', 'lr')} SELECT c_nationkey, cast(w AS bigint) AS w, got AS allocated FROM lr""")
def largest_remainder(t):
    groups = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("w"))
    return survey.largest_remainder(groups, "w", F.lit(997), ["c_nationkey"]).select("c_nationkey", "w", "allocated")


@query("allocate_cells", sql("frame", f"{CELLS} SELECT stratum, gid, cast(candidates AS bigint) AS candidates, allocated FROM cells"))
def allocate_cells(t):
    counts = t.views.frame.groupBy("stratum", "gid").agg(F.count("*").alias("candidates"))
    return survey.allocate_cells(counts, TOTAL, ["stratum", "gid"])


@query("systematic_sample", sql("frame", f"{SAMPLE} SELECT gid, idx, chainage, stratum, cast(candidates AS bigint) AS cell_candidates, allocated AS cell_allocated, inclusion_probability, weight FROM smp"))
def systematic_sample(t):
    return survey.systematic_sample(t.views.frame, TOTAL, _fraction())


@query("sample_design_report", sql("frame", f"""{SAMPLE}, f AS (SELECT stratum, count(*) AS frame_points FROM frame GROUP BY 1), s AS (SELECT stratum, count(*) AS points, min(weight) AS w0, max(weight) AS w1 FROM smp GROUP BY 1),
    j AS (SELECT stratum, points, frame_points, {rnd('points/(SELECT count(*) FROM smp)::double', 6)} AS ss, {rnd('frame_points/(SELECT count(*) FROM frame)::double', 6)} AS sf, w0, w1 FROM s JOIN f USING (stratum))
    SELECT stratum, cast(points AS bigint) AS points, cast(frame_points AS bigint) AS frame_points, ss AS share_of_sample, sf AS share_of_frame, {rnd('sf/ss', 6)} AS design_weight, {rnd('w0', 6)} AS weight_min, {rnd('w1', 6)} AS weight_max, {rnd('w1-w0', 8)}<=1e-6 AS design_weight_valid FROM j"""))
def sample_design_report(t):
    return survey.sample_design_report(t.views.frame, _sample(t))


@query("label_template", sql("frame", f"{SAMPLE} SELECT gid, chainage, 'unknown' AS label, '' AS interpreter, '' AS day_text FROM smp"))
def label_template(t):
    return survey.systematic_sample(t.views.frame, TOTAL, _fraction()).select("gid", "chainage", F.lit("unknown").alias("label"), F.lit("").alias("interpreter"), F.lit("").alias("day_text"))


@query("label_coverage", sql("frame", f"""{_FRAME_LABELS}, k AS (SELECT DISTINCT f.gid, f.idx FROM frame f JOIN lb ON f.gid=lb.gid AND round(f.chainage*1e6)=round(lb.chainage*1e6) AND lb.label<>'unknown')
    SELECT stratum, cast(count(k.idx) AS bigint) AS labelled, cast(count(*) AS bigint) AS candidates, {rnd('count(k.idx)/count(*)::double', 6)} AS fraction FROM frame f LEFT JOIN k ON f.gid=k.gid AND f.idx=k.idx GROUP BY 1"""))
def label_coverage(t):
    labels = frame_labels(t).where("label <> 'unknown'").select("gid", F.rint(F.col("chainage") * 1e6).alias("m"))
    known = t.views.frame.withColumn("m", F.rint(F.col("chainage") * 1e6)).join(labels, ["gid", "m"]).select("gid", "idx")
    return survey.label_coverage(t.views.frame, known)


_HAJEK = f"""h AS (SELECT count(*) AS sample_size, count(*) FILTER (WHERE label<>'unknown') AS labelled_points, count(*) FILTER (WHERE label='unknown') AS unknown_points, count(*) FILTER (WHERE label='canopy') AS canopy_points,
 sum(weight) AS al, sum(weight) FILTER (WHERE label<>'unknown') AS de, coalesce(sum(weight) FILTER (WHERE label='canopy'),0) AS ca, coalesce(sum(weight) FILTER (WHERE label='unknown'),0) AS un, sum(weight*weight) FILTER (WHERE label<>'unknown') AS sq FROM pts),
 hj AS (SELECT cast(sample_size AS bigint) AS sample_size, cast(labelled_points AS bigint) AS labelled_points, cast(unknown_points AS bigint) AS unknown_points, cast(canopy_points AS bigint) AS canopy_points, {rnd('ca/de', 6)} AS proportion, {rnd('un/al', 6)} AS unknown_share,
 {rnd('ca/al', 6)} AS bound_low, {rnd('(ca+un)/al', 6)} AS bound_high, {rnd('de*de/sq', 3)} AS effective_size, {rnd('ca/(SELECT count(*) FROM frame)', 6)} AS horvitz_thompson FROM h)"""


@query("hajek_estimate", sql("frame", f"{LABELLED}, {_HAJEK} SELECT * FROM hj"))
def hajek_estimate(t):
    return survey.hajek_estimate(_labelled(t), _frame_size(t))


@query("kish_effective_size", sql("frame", f"{LABELLED} SELECT stratum, {rnd('sum(weight)*sum(weight)/sum(weight*weight)', 6)} AS effective_size FROM pts GROUP BY 1"))
def kish_effective_size(t):
    return survey.kish_effective_size(_sample(t), ["stratum"]).select("stratum", rounded("effective_size", 6).alias("effective_size"))


_WR = """wp AS (SELECT sum(weight*CASE WHEN label='canopy' THEN 1 ELSE 0 END)/sum(weight) AS p FROM pts WHERE label<>'unknown'),
 wv AS (SELECT sum(weight*weight*pow(CASE WHEN label='canopy' THEN 1 ELSE 0 END - p,2))/pow(sum(weight),2)*count(*)/(count(*)-1) AS v FROM pts, wp WHERE label<>'unknown')"""


@query("wr_variance", sql("frame", f"{LABELLED}, {_WR} SELECT {rnd('v', 9)} AS variance FROM wv"))
def wr_variance(t):
    return survey.wr_variance(_labelled(t)).select(rounded("variance", 9).alias("variance"))


_Z2 = 1.959963984540054**2


@query("estimate_report", sql("frame", f"""{LABELLED}, {_HAJEK}, {_WR}, w AS (SELECT hj.*, v, round_even(effective_size,0) AS n, round_even(proportion*round_even(effective_size,0),0)/round_even(effective_size,0) AS q FROM hj, wv),
    x AS (SELECT *, (q+{_Z2}/(2*n))/(1+{_Z2}/n) AS c, 1.959963984540054*sqrt(q*(1-q)/n+{_Z2}/(4*n*n))/(1+{_Z2}/n) AS s FROM w)
    SELECT sample_size, labelled_points, unknown_points, canopy_points, proportion, unknown_share, bound_low, bound_high, effective_size, horvitz_thompson, {rnd('v', 8)} AS variance, {rnd('sqrt(v)', 6)} AS standard_error,
    {rnd('greatest(0.0,c-s)', 6)} AS interval_low, {rnd('least(1.0,c+s)', 6)} AS interval_high, {rnd('(least(1.0,c+s)-greatest(0.0,c-s))/2*100', 3)} AS half_width_pp FROM x"""))
def estimate_report(t):
    return survey.estimate_report(_labelled(t), _frame_size(t))


@query("lag_autocorrelation", sql("frame", f"""b AS (SELECT gid, idx, CASE WHEN stratum='mapped_overlap' THEN 1.0::double ELSE 0.0 END AS v FROM frame), m AS (SELECT gid, avg(v) AS m, var_pop(v) AS s FROM b GROUP BY 1 HAVING var_pop(v)>0),
    j AS (SELECT x.gid, l.lag, count(*) AS pairs, sum((x.v-m.m)*(y.v-m.m))/max(m.s) AS c FROM b x JOIN m ON x.gid=m.gid, (SELECT unnest(generate_series(1,24)) AS lag) l, b y WHERE y.gid=x.gid AND y.idx=x.idx+l.lag GROUP BY 1,2 HAVING count(*)>=8)
    SELECT cast(lag AS int) AS lag, {rnd('sum(c)/sum(pairs)', 9)} AS rho, cast(sum(pairs) AS bigint) AS pairs FROM j GROUP BY 1"""))
def lag_autocorrelation(t):
    table = survey.lag_autocorrelation(t.views.frame, F.when(F.col("stratum") == "mapped_overlap", 1.0).otherwise(0.0))
    return table.select("lag", rounded("rho", 9).alias("rho"), "pairs")



def _series(t):
    """Seven unequal segments numbered consecutively by an ordinal over the orders of each."""
    from terrascreen.operators.ordering import ordinal

    rows = t.orders.select(F.least(F.col("o_custkey") % 11, F.lit(6)).alias("gid"), "o_orderkey", F.col("o_orderstatus"))
    return materialise(ordinal(rows, ["gid"], [F.col("o_orderkey")], "idx").withColumn("idx", F.col("idx") - 1), "series")


_BASE = f"""sr AS (SELECT least(o_custkey % 11, 6) AS gid, row_number() OVER (PARTITION BY least(o_custkey % 11, 6) ORDER BY o_orderkey)-1 AS idx, CASE WHEN o_orderstatus='F' THEN 1.0::double ELSE 0.0 END AS v FROM orders),
 sz AS (SELECT gid, count(*) AS candidates FROM sr GROUP BY 1), sb AS (SELECT *, greatest(1, cast(round_even({TOTAL}::double*candidates/(SELECT sum(candidates) FROM sz),0) AS bigint)) AS base FROM sz),
 ex AS (SELECT sum(base)-{TOTAL} AS e FROM sb), lv AS (SELECT unnest(generate_series(1,{TOTAL})) AS l), lc AS (SELECT l, (SELECT sum(greatest(0, base-l)) FROM sb) AS cut FROM lv),
 lb AS (SELECT max(l) AS l FROM lc, ex WHERE e>0 AND cut>=e), kp AS (SELECT lb.l, (SELECT cut FROM lc WHERE lc.l=lb.l)-e AS keep FROM lb, ex),
 fl AS (SELECT gid, candidates, base, CASE WHEN l IS NULL OR base<=l THEN base ELSE l + CASE WHEN row_number() OVER (PARTITION BY base>l ORDER BY gid DESC)<=keep THEN 1 ELSE 0 END END AS flat FROM sb, kp),
 {remainder_sql('fl', 'candidates', f'greatest(0, {TOTAL}-(SELECT sum(base) FROM sb))', 'gid', 'am')}, seg AS (SELECT gid, candidates, flat+got AS allocated FROM am),
 st AS (SELECT gid, candidates, allocated, d AS draw, candidates/allocated::double AS step, (((d*7919+gid*104729) % 100003)/100003.0::double)*(candidates/allocated::double) AS start FROM seg, (SELECT unnest(generate_series(1,{{draws}})) AS d)),
 pk AS (SELECT gid, draw, candidates, allocated, step, i, least(candidates-1, cast(floor(start+i*step) AS bigint)) AS idx FROM (SELECT *, unnest(generate_series(0, allocated-1)) AS i FROM st))"""


def _base(draws):
    return _BASE.replace("{draws}", str(draws))


def _starts():
    return ((F.col("draw") * 7919 + F.col("gid") * 104729) % 100003) / F.lit(100003.0)


@query("replicate_variance", f"""WITH {_base(DRAWS)}, es AS (SELECT draw, sum(v)/{TOTAL}.0::double AS e FROM pk JOIN sr USING (gid, idx) GROUP BY 1), rk AS (SELECT e, row_number() OVER (ORDER BY e)-1 AS r FROM es),
    fr AS (SELECT avg(v) AS p, count(*) AS n FROM sr), a AS (SELECT avg(e) AS m, var_samp(e) AS v, min(e) AS lo, max(e) AS hi FROM es), x AS (SELECT *, p*(1-p)/{TOTAL} AS wr, p*(1-p)/{TOTAL}*(n-{TOTAL})/(n-1) AS wo FROM a, fr)
    SELECT {rnd('m', 6)} AS mean_estimate, {rnd('v', 9)} AS variance, {rnd('wr', 9)} AS srswr_variance, {rnd('wo', 9)} AS srswor_variance, {rnd('v/wr', 4)} AS design_effect, {rnd('v/wo', 4)} AS design_effect_finite, {rnd(f'v*{(2 / (DRAWS - 1)) ** 0.5!r}', 10)} AS mc_standard_error,
    {rnd('lo', 6)} AS lowest, {rnd('hi', 6)} AS highest, {', '.join(f"{rnd(f'(SELECT e FROM rk WHERE r={int(q * (DRAWS - 1))})', 6)} AS {n}" for n, q in (('q025', .025), ('q25', .25), ('q50', .5), ('q75', .75), ('q975', .975)))} FROM x""")
def replicate_variance(t):
    return survey.replicate_variance(_series(t), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0), TOTAL, DRAWS, _starts())


@query("distinct_realisations", f"""WITH {_base(TRIALS)}, ls AS (SELECT gid, draw, list(idx ORDER BY i) AS l, max(allocated) AS allocated, max(candidates) AS candidates, max(step) AS step FROM pk GROUP BY 1,2), vr AS (SELECT gid, min(v)<>max(v) AS varies FROM sr GROUP BY 1)
    SELECT gid, cast(max(allocated) AS bigint) AS allocated, cast(max(candidates) AS bigint) AS candidates, {rnd('max(step)', 4)} AS step, cast(count(DISTINCT l) AS bigint) AS "distinct", bool_or(varies) AS varies, count(DISTINCT l)<20 AND bool_or(varies) AS few FROM ls JOIN vr USING (gid) GROUP BY 1""")
def distinct_realisations(t):
    return survey.distinct_realisations(_series(t), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), TOTAL, TRIALS, _starts())


@query("sampling_plan", sql("vertices rects", f"""{SEGMENTS}, {GRID}, {_BUFFERED}, w AS (SELECT gid, max(length_m) AS length_m, max(overlap_m) FILTER (WHERE buffer_m=0) AS o0, max(overlap_m) FILTER (WHERE buffer_m=5) AS o5 FROM bm WHERE vegetation='trees' GROUP BY gid),
    tt AS (SELECT 'mapped_overlap' AS stratum, sum(o0) AS length_m FROM w UNION ALL SELECT 'proximity_only', sum(o5-o0) FROM w UNION ALL SELECT 'mapped_non_overlap', sum(length_m-o5) FROM w), f AS (SELECT sum(length_m) AS m, sum(floor(length_m/2.0)) AS c FROM w), {remainder_sql('tt', 'length_m', str(TOTAL), 'stratum', 'pl')}
    SELECT stratum, length_m::double AS length_m, {rnd('length_m/m', 6)} AS share, got AS points, {rnd('length_m/got', 6)} AS systematic_step_m, m::double AS frame_m, cast(c AS bigint) AS candidates, (m-c*2.0)::double AS excluded_m FROM pl, f"""))
def sampling_plan(t):
    lengths = materialise(covers.stratum_lengths(_buffer_metrics(t).where("vegetation = 'trees'")), "strata")
    plan = survey.sampling_plan(lengths, TOTAL, 2.0)
    return plan.select("stratum", "length_m", rounded("share", 6).alias("share"), "points", rounded("systematic_step_m", 6).alias("systematic_step_m"), "frame_m", "candidates", "excluded_m")


_BANDS = "bo AS (SELECT vec_id AS window_id, b AS band, [0.05,0.5,1.0,2.5,10.0][b]::double AS lobe_m, embedding[2*b-1]::double*3 AS east, embedding[2*b]::double*3 AS north FROM embeddings, (SELECT unnest(generate_series(1,5)) AS b))"
_PAIRWISE = f"""{_BANDS}, bp AS (SELECT x.window_id, x.band AS b1, y.band AS b2, greatest(x.lobe_m,y.lobe_m) AS lobe, sqrt(pow(x.east-y.east,2)+pow(x.north-y.north,2)) AS d FROM bo x JOIN bo y ON x.window_id=y.window_id AND x.band<=y.band),
 bs AS (SELECT window_id, max(d) FILTER (WHERE lobe<=0.5) AS spread, max(d) FILTER (WHERE b2<=2) AS s2, max(d) FILTER (WHERE b2<=3) AS s3, max(d) FILTER (WHERE b2<=4) AS s4, max(d) AS s5 FROM bp GROUP BY 1)"""


def _offsets(t):
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(lobe).alias("lobe_m"), (F.element_at("embedding", 2 * i - 1).cast("double") * 3).alias("east"), (F.element_at("embedding", 2 * i).cast("double") * 3).alias("north"))
                                for i, lobe in enumerate(survey.BAND_LOBES_M, start=1)])).alias("b")
    return t.embeddings.select(F.col("vec_id").alias("window_id"), bands).select("window_id", "b.*")


@query("band_verdict", f"""WITH {_PAIRWISE} SELECT bs.window_id, {rnd('spread', 6)} AS spread, CASE WHEN spread<=0.5 THEN 'consistent' ELSE 'inconsistent' END AS verdict, {rnd('sqrt(east*east+north*north)', 6)} AS offset_m FROM bs JOIN bo ON bs.window_id=bo.window_id AND band=1""")
def band_verdict(t):
    return survey.band_verdict(_offsets(t)).select("window_id", rounded("spread", 6).alias("spread"), "verdict", rounded("offset_m", 6).alias("offset_m"))


@query("band_summary", f"""WITH {_PAIRWISE}, lg AS (SELECT 2 AS bands, s2 AS s FROM bs UNION ALL SELECT 3, s3 FROM bs UNION ALL SELECT 4, s4 FROM bs UNION ALL SELECT 5, s5 FROM bs)
    SELECT bands, cast(count(*) FILTER (WHERE s<=0.5) AS bigint) AS consistent, cast(count(*) AS bigint) AS windows, {rnd('max(s)', 6)} AS max_spread, {rnd('median(s)', 6)} AS median_spread FROM lg GROUP BY 1""")
def band_summary(t):
    table = survey.band_summary(survey.band_verdict(_offsets(t)))
    return table.select("bands", "consistent", "windows", rounded("max_spread", 6).alias("max_spread"), rounded("median_spread", 6).alias("median_spread"))
