"""Survey sampling: allocation, systematic draws, estimators and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded, wilson_bounds
from terrascreen.operators.ordering import blocked_scan, exact_quantiles, materialise, ordered_blocks, ordinal

CANOPY, NOT_CANOPY, UNKNOWN = "canopy", "not_canopy", "unknown"
# Fewest pairs for a lag, largest lag reported, distinct draws that count as few.
MINIMUM_PAIRS, REPORTED_LAGS, FEW_DISTINCT = 8, 24, 20
LAG_BLOCK = 4096


def largest_remainder(groups: DataFrame, weight: str, total: Column, order: list[str], name: str = "allocated") -> DataFrame:
    """Split ``total`` over groups by weight: floors first, the rest by fraction, weight, order."""
    size = groups.agg(F.sum(weight).cast("double")).scalar()
    quota = groups.withColumns({"_size": size, "_total": total}).withColumn("_exact", F.col(weight) * F.col("_total") / F.col("_size"))
    quota = materialise(quota.withColumn("_floor", F.floor("_exact").cast("bigint")).drop("_size"), "quota")
    short = quota.agg((F.max("_total") - F.sum("_floor")).alias("s")).scalar()
    ranked = ordinal(quota, [], [(F.col("_exact") - F.col("_floor")).desc(), F.col(weight).desc(), *[F.col(c) for c in order]], "_rank")
    extra = F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)
    return ranked.withColumn("_short", short).withColumn(name, F.col("_floor") + extra).drop("_exact", "_floor", "_rank", "_short", "_total")


def allocate_cells(counts: DataFrame, total: int, order: list[str], n: str = "candidates") -> DataFrame:
    """At least one point per cell, the rest in proportion to what each cell has left."""
    stats = counts.agg(F.struct(F.count("*").alias("cells"), F.sum(n).alias("sum")).alias("s"))
    marked = counts.withColumn("_s", stats.scalar())
    spare = F.when(F.col("_s.sum") == F.col("_s.cells"), F.col(n)).otherwise(F.col(n) - 1)
    marked = marked.withColumn("_spare", spare).drop("_s")
    rest = counts.agg(F.lit(total) - F.count("*")).scalar()
    return largest_remainder(marked, "_spare", rest, order, "_more").withColumn("allocated", F.col("_more") + 1).drop("_more", "_spare")


def allocate_segments(counts: DataFrame, total: int, order: str = "gid", n: str = "candidates") -> DataFrame:
    """Rounded proportional allocation, at least one each; a surplus is taken from the largest.

    Taking one from the currently largest again and again flattens the top to a level, so the
    level is found on the histogram of rounded quotas instead of looping.
    """
    size = counts.agg(F.sum(n).cast("double")).scalar()
    base = counts.withColumn("_size", size).withColumn("_base", F.greatest(F.lit(1), F.rint(F.lit(total) * F.col(n) / F.col("_size")).cast("bigint"))).drop("_size")
    base = materialise(base, "base")
    excess = base.agg(F.sum("_base") - F.lit(total)).scalar()
    # One row per distinct quota, at most about sqrt(2 total) of them.
    hist = base.groupBy("_base").agg(F.count("*").alias("c"))
    upper = Window.orderBy(F.col("_base").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = hist.withColumns({"cnt": F.sum("c").over(upper), "mass": F.sum(F.col("c") * F.col("_base")).over(upper), "next": F.lead("_base", 1, 0).over(Window.orderBy(F.col("_base").desc()))})
    levels = levels.withColumn("_e", excess)
    # Lowering everything above level L to L removes mass - cnt * L, with L between next and _base.
    level = F.floor((F.col("mass") - F.col("_e")) / F.col("cnt"))
    fits = levels.where((F.col("_e") > 0) & (level >= F.col("next")) & (level < F.col("_base")))
    chosen = fits.agg(F.max(F.struct(level.cast("bigint").alias("level"), (F.col("mass") - F.col("_e") - level * F.col("cnt")).cast("bigint").alias("keep"))).alias("l")).scalar()
    marked = base.withColumns({"_l": chosen, "_e": excess})
    lowered = F.when(F.col("_base") <= F.col("_l.level"), F.col("_base")).otherwise(F.col("_l.level"))
    over = marked.where(F.col("_base") > F.col("_l.level"))
    keepers = ordinal(over, [], [F.col(order).desc()], "_k").select(order, "_k")
    flattened = marked.join(keepers, order, "left").withColumn(
        "_flat", F.when(F.col("_e") > 0, lowered + F.when(F.col("_k") <= F.col("_l.keep"), 1).otherwise(0)).otherwise(F.col("_base")))
    missing = base.agg(F.greatest(F.lit(total) - F.sum("_base"), F.lit(0))).scalar()
    topped = largest_remainder(flattened.drop("_l", "_e", "_k", "_base"), n, missing, [order], "_more")
    return topped.withColumn("allocated", F.col("_flat") + F.col("_more")).drop("_flat", "_more")


def _position(start: Column, step: Column, i: Column, n: Column) -> Column:
    return F.least(n - 1, F.floor(start + i * step).cast("bigint"))


def systematic_sample(frame: DataFrame, total: int, fraction: Column, keys: list[str] = ("stratum", "gid"), order: str = "chainage") -> DataFrame:
    """Stratified systematic sample with inclusion probabilities.

    ``fraction`` is the random start in [0, 1) of a row's cell. A row decides from its own
    position whether the draw hits it, so nothing is exploded or joined per draw.
    """
    keys = list(keys)
    counts = frame.groupBy(*keys).agg(F.count("*").alias("candidates"))
    cells = allocate_cells(counts, total, keys)
    placed = ordinal(frame, keys, [F.col(order)], "_place").withColumn("_place", F.col("_place") - 1).join(cells, keys)
    n, k = F.col("candidates"), F.col("allocated")
    step = n / k
    start = fraction * step
    guess = F.ceil((F.col("_place") - start) / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = guess + shift
        hit = hit | ((i >= 0) & (i < k) & (_position(start, step, i, n) == F.col("_place")))
    drawn = placed.where(hit)
    return drawn.select(*frame.columns, n.alias("cell_candidates"), k.alias("cell_allocated"), rounded(k / n, 8).alias("inclusion_probability"), rounded(n / k, 8).alias("weight"))


def sample_design_report(frame: DataFrame, sample: DataFrame) -> DataFrame:
    """Per stratum: shares of sample and frame, design weight, weight range and its validity."""
    f = frame.groupBy("stratum").agg(F.count("*").alias("frame_points"))
    s = sample.groupBy("stratum").agg(F.count("*").alias("points"), F.min("weight").alias("w0"), F.max("weight").alias("w1"))
    totals = frame.agg(F.count("*")).scalar(), sample.agg(F.count("*")).scalar()
    joined = s.join(f, "stratum").withColumns({"_f": totals[0], "_s": totals[1]})
    joined = joined.withColumns({"share_of_sample": rounded(F.col("points") / F.col("_s"), 6), "share_of_frame": rounded(F.col("frame_points") / F.col("_f"), 6)})
    return joined.select("stratum", "points", "frame_points", "share_of_sample", "share_of_frame", rounded(F.col("share_of_frame") / F.col("share_of_sample"), 6).alias("design_weight"),
                         rounded("w0", 6).alias("weight_min"), rounded("w1", 6).alias("weight_max"), (rounded(F.col("w1") - F.col("w0"), 8) <= 1e-6).alias("design_weight_valid"))


def label_coverage(frame: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per stratum: labelled candidates, all candidates and their ratio."""
    marks = labelled.select("gid", "idx").distinct().withColumn("_hit", F.lit(1))
    joined = frame.join(marks, ["gid", "idx"], "left")
    counts = joined.groupBy("stratum").agg(F.count("_hit").alias("labelled"), F.count("*").alias("candidates"))
    return counts.withColumn("fraction", rounded(F.col("labelled") / F.col("candidates"), 6))


def sample_problems(points: DataFrame) -> DataFrame:
    """Rows an estimator must not use: weight missing or below one, label missing or unknown to it."""
    problem = (F.when(F.col("weight").isNull(), "missing_weight").when(F.col("weight") < 1, "weight_below_one")
               .when(F.col("label").isNull(), "missing_label").when(~F.col("label").isin(CANOPY, NOT_CANOPY, UNKNOWN), "bad_label"))
    return points.select("gid", "chainage", problem.alias("problem")).where(F.col("problem").isNotNull())


def hajek_estimate(points: DataFrame, frame_size: Column, keys: list[str] = ()) -> DataFrame:
    """Weighted share of canopy among decided points, with the bounds the unknown ones allow."""
    w, label = F.col("weight"), F.col("label")
    decided, canopy = label != UNKNOWN, label == CANOPY
    sums = points.groupBy(*keys).agg(
        F.count("*").alias("sample_size"), F.count_if(decided).alias("labelled_points"), F.count_if(~decided).alias("unknown_points"), F.count_if(canopy).alias("canopy_points"),
        F.sum(w).alias("_all"), F.sum(F.when(decided, w)).alias("_dec"), F.coalesce(F.sum(F.when(canopy, w)), F.lit(0.0)).alias("_can"),
        F.coalesce(F.sum(F.when(~decided, w)), F.lit(0.0)).alias("_unk"), F.sum(F.when(decided, w * w)).alias("_sq"))
    return sums.withColumn("_n", frame_size).select(
        *keys, "sample_size", "labelled_points", "unknown_points", "canopy_points", rounded(F.try_divide("_can", "_dec"), 6).alias("proportion"),
        rounded(F.col("_unk") / F.col("_all"), 6).alias("unknown_share"), rounded(F.col("_can") / F.col("_all"), 6).alias("bound_low"),
        rounded((F.col("_can") + F.col("_unk")) / F.col("_all"), 6).alias("bound_high"), rounded(F.try_divide(F.col("_dec") * F.col("_dec"), F.col("_sq")), 3).alias("effective_size"),
        rounded(F.col("_can") / F.col("_n"), 6).alias("horvitz_thompson"))


def kish_effective_size(points: DataFrame, keys: list[str] = ()) -> DataFrame:
    """How many equally weighted points the weights are worth."""
    return points.groupBy(*keys).agg((F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("effective_size"))


def wr_variance(points: DataFrame) -> DataFrame:
    """With-replacement variance of the weighted share; null below two decided points."""
    decided = points.where(F.col("label") != UNKNOWN).withColumn("_y", F.when(F.col("label") == CANOPY, 1.0).otherwise(0.0))
    share = decided.agg(F.sum(F.col("weight") * F.col("_y")) / F.sum("weight")).scalar()
    centred = decided.withColumn("_d", F.col("_y") - share)
    w = F.col("weight")
    n = F.count("*")
    value = F.sum(w * w * F.col("_d") * F.col("_d")) / (F.sum(w) * F.sum(w)) * F.try_divide(n, n - 1)
    return centred.agg(F.when(n >= 2, value).alias("variance"))


def estimate_report(points: DataFrame, frame_size: Column) -> DataFrame:
    """Estimate, variance and the Wilson interval at the rounded effective size (one row)."""
    row = hajek_estimate(points, frame_size).withColumn("_v", wr_variance(points).scalar())
    row = row.withColumn("_t", F.rint("effective_size").cast("bigint"))
    row = row.withColumn("_s", F.rint(F.col("proportion") * F.col("_t")).cast("bigint"))
    low, high = wilson_bounds(F.col("_s"), F.col("_t"))
    row = row.withColumns({"_lo": low, "_hi": high})
    return row.withColumns({
        "variance": rounded("_v", 8), "standard_error": rounded(F.sqrt("_v"), 6), "interval_low": rounded("_lo", 6), "interval_high": rounded("_hi", 6),
        "half_width_pp": rounded((F.col("_hi") - F.col("_lo")) / 2 * 100, 3)}).drop("_v", "_t", "_s", "_lo", "_hi")


def lag_autocorrelation(points: DataFrame, value: Column, max_lag: int = REPORTED_LAGS) -> DataFrame:
    """Pair-weighted autocorrelation within segments, lags 1..max_lag; constant segments skipped.

    Each segment is cut into index blocks that borrow ``max_lag`` rows of the next block, so one
    sort of the data serves every lag and no segment sits in one task.
    """
    block = F.floor(F.col("idx") / LAG_BLOCK).cast("bigint")
    homes = F.when(F.col("idx") % LAG_BLOCK < max_lag, F.array(block, block - 1)).otherwise(F.array(block))
    rows = points.select("gid", "idx", value.cast("double").alias("v")).withColumn("home", F.explode(homes))
    window = Window.partitionBy("gid", "home").orderBy("idx")
    ahead = {f"a{g}": F.lead(F.struct("idx", "v"), g).over(window) for g in range(1, max_lag + 1)}
    own = rows.withColumns(ahead).where(F.floor(F.col("idx") / LAG_BLOCK) == F.col("home"))
    aggs = [F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var")]
    for g in range(1, max_lag + 1):
        there = F.col(f"a{g}.idx") == F.col("idx") + g
        aggs += [F.count_if(there).alias(f"p{g}"), F.sum(F.when(there, F.col("v") * F.col(f"a{g}.v"))).alias(f"xy{g}"), F.sum(F.when(there, F.col("v") + F.col(f"a{g}.v"))).alias(f"s{g}")]
    sums = own.groupBy("gid").agg(*aggs).where("var > 0")
    lags = F.array(*[F.struct(F.lit(g).alias("lag"), F.col(f"p{g}").alias("p"), F.col(f"xy{g}").alias("xy"), F.col(f"s{g}").alias("s")) for g in range(1, max_lag + 1)])
    long = sums.select("m", "var", F.explode(lags).alias("l")).where(F.col("l.p") >= MINIMUM_PAIRS)
    covariance = F.col("l.xy") - F.col("m") * F.col("l.s") + F.col("l.p") * F.col("m") * F.col("m")
    return long.groupBy(F.col("l.lag").alias("lag")).agg((F.sum(covariance / F.col("var")) / F.sum("l.p")).alias("rho"), F.sum("l.p").alias("pairs"))


def placement_inflation(spans: DataFrame, assessed_m: Column, total: int, step: float) -> DataFrame:
    """Runs of the mapped class (rows with ``value`` true of :func:`linear.runs`) and the variance inflation that their mean length suggests.

    A systematic sample of an autocorrelated series inflates variance by about patch length over sampling step; a rough bound, no estimate.
    Without runs the mean is 0 and the inflation 1.
    """
    n = F.when(F.col("value"), F.col("n"))
    row = spans.agg(F.count(n).alias("runs"), F.coalesce(F.avg(n), F.lit(0.0)).alias("_mean"), F.coalesce(F.max(n), F.lit(0)).alias("longest_frames")).withColumn("_m", assessed_m)
    return row.select("runs", rounded("_mean", 2).alias("mean_length_frames"), "longest_frames", rounded(F.col("_mean") * step, 2).alias("mean_length_m"), rounded(F.col("_m") / total, 4).alias("sampling_step_m"),
                      rounded(1 + F.col("_mean") * step / (F.col("_m") / total), 4).alias("inflation_for_random_placement"))


def draw_starts(cells: DataFrame, draws: int, fraction: Column) -> DataFrame:
    """One row per draw and segment with its start; ``fraction`` may use ``draw`` and ``gid``."""
    rows = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    step = F.col("candidates") / F.col("allocated")
    return rows.withColumns({"_step": step, "_start": fraction * step})


def _before(place: Column) -> Column:
    """How many sampling positions of start 0 lie below a place (whole numbers, so exact)."""
    n = F.col("candidates")
    return F.call_function("div", (place * F.col("allocated") + n - 1).cast("bigint"), n)


def _entry(place: Column) -> Column:
    """The start in (0, step) at which one of the positions comes to a place."""
    return place - (_before(place) - 1) * (F.col("candidates") / F.col("allocated"))


def _looked_up(events: DataFrame, starts: DataFrame, scans: dict[str, tuple[str, Column]]) -> DataFrame:
    """Starts with running values over the events (``gid, at, change``) at or before them, from one common order."""
    rows = events.select("gid", "at", "change", F.lit(None).cast("int").alias("draw")).unionByName(
        starts.select("gid", F.col("_start").alias("at"), F.lit(0.0).alias("change"), "draw"))
    blocks = ordered_blocks(rows, [F.col("gid"), F.col("at"), F.asc_nulls_first("draw")], "starts")
    return blocked_scan(blocks, ["gid"], scans).where(F.col("draw").isNotNull())


def replicate_variance(points: DataFrame, indicator: Column, total: int, draws: int, fraction: Column) -> DataFrame:
    """Variance of the systematic-sample share over many starts against simple random sampling.

    Within a segment the sampled sum is a step function of the start: a candidate comes in at one start and leaves where the next one comes in.
    Its steps are ordered once together with all starts, and a draw reads the running sum at its start; no sample is ever listed.
    """
    series = points.select("gid", "idx", indicator.cast("double").alias("v"))
    counts = series.groupBy("gid").agg(F.count("*").alias("candidates"))
    cells = materialise(allocate_segments(counts, total).select("gid", "candidates", "allocated"), "cells")
    held = series.where("v <> 0").join(cells, "gid")
    place, step = F.col("idx"), F.col("candidates") / F.col("allocated")
    base = held.groupBy("gid").agg(F.sum(F.col("v") * (_before(place + 1) - _before(place))).alias("base"))
    both = F.explode(F.array(F.struct(_entry(place).alias("at"), F.col("v").alias("change"), place.alias("to")),
                             F.struct(_entry(place + 1).alias("at"), (-F.col("v")).alias("change"), (place + 1).alias("to")))).alias("e")
    events = held.select("gid", "candidates", step.alias("_step"), both).where("e.at > 0 and e.at < _step and e.to < candidates").select("gid", "e.at", "e.change")
    sums = _looked_up(events, draw_starts(cells, draws, fraction), {"moved": ("sum", F.col("change"))})
    whole = base.agg(F.coalesce(F.sum("base"), F.lit(0.0))).scalar()
    drawn = sums.groupBy("draw").agg(F.sum("moved").alias("moved"))
    estimates = materialise(drawn.select("draw", ((F.col("moved") + whole) / F.lit(float(total))).alias("estimate")), "estimates")
    frame = series.agg(F.struct(F.avg("v").alias("p"), F.count("*").alias("n")).alias("f")).scalar()
    probs = {"q025": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q975": 0.975}
    # The index rule floor(q (n - 1)) is the lower order statistic of the linear rule; draws are bounded.
    ranked = estimates.withColumn("_r", F.row_number().over(Window.orderBy("estimate")) - 1)
    quantiles = ranked.agg(F.struct(*[F.max(F.when(F.col("_r") == F.lit(int(q * (draws - 1))), F.col("estimate"))).alias(n) for n, q in probs.items()]).alias("q")).scalar()
    row = estimates.agg(F.avg("estimate").alias("mean"), F.var_samp("estimate").alias("variance"), F.min("estimate").alias("lowest"), F.max("estimate").alias("highest"))
    row = row.withColumns({"_f": frame, "_q": quantiles})
    p, n = F.col("_f.p"), F.col("_f.n")
    with_replacement = p * (1 - p) / total
    row = row.withColumns({"srswr": with_replacement, "srswor": with_replacement * (n - total) / (n - 1)})
    return row.select(
        rounded("mean", 6).alias("mean_estimate"), rounded("variance", 9).alias("variance"), rounded("srswr", 9).alias("srswr_variance"), rounded("srswor", 9).alias("srswor_variance"),
        rounded(F.try_divide("variance", "srswr"), 4).alias("design_effect"), rounded(F.try_divide("variance", "srswor"), 4).alias("design_effect_finite"),
        rounded(F.col("variance") * F.lit((2 / (draws - 1)) ** 0.5), 10).alias("mc_standard_error"), rounded("lowest", 6).alias("lowest"), rounded("highest", 6).alias("highest"),
        *[rounded(F.col(f"_q.{name}"), 6).alias(name) for name in probs])


def distinct_realisations(points: DataFrame, indicator: Column, total: int, trials: int, fraction: Column) -> DataFrame:
    """Per segment: different systematic samples seen in the trials, and whether it varies.

    A sample changes only where a candidate comes in, so two starts draw the same one if the last such start at or before them is the same.
    """
    series = points.select("gid", "idx", indicator.cast("int").alias("v"))
    counts = series.groupBy("gid").agg(F.count("*").alias("candidates"), (F.min("v") != F.max("v")).alias("varies"))
    cells = materialise(allocate_segments(counts.select("gid", "candidates"), total).select("gid", "candidates", "allocated").join(counts.select("gid", "varies"), "gid"), "cells")
    step = F.col("candidates") / F.col("allocated")
    entries = series.join(cells, "gid").select("gid", _entry(F.col("idx")).alias("at"), step.alias("_step"), F.lit(0.0).alias("change")).where("at > 0 and at < _step")
    pieces = _looked_up(entries, draw_starts(cells, trials, fraction), {"piece": ("max", F.when(F.col("draw").isNull(), F.col("at")))})
    seen = pieces.groupBy("gid").agg(F.countDistinct(F.coalesce("piece", F.lit(0.0))).alias("distinct"))
    return cells.join(seen, "gid").select("gid", "allocated", "candidates", rounded(step, 4).alias("step"), "distinct", "varies", ((F.col("distinct") < FEW_DISTINCT) & F.col("varies")).alias("few"))


def sampling_plan(lengths: DataFrame, points: int, step: float) -> DataFrame:
    """Frame size, candidates and the allocation of points over strata by length."""
    frame = lengths.agg(F.struct(F.sum("length_m").alias("m"), F.sum(F.floor(F.col("length_m") / step)).alias("c")).alias("f")).scalar()
    strata = lengths.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).alias("v")) for s in ("mapped_overlap", "proximity_only", "mapped_non_overlap")])).alias("p"))
    totals = strata.groupBy(F.col("p.stratum").alias("stratum")).agg(F.sum("p.v").alias("length_m"))
    plan = largest_remainder(totals, "length_m", F.lit(points), ["stratum"], "points").withColumn("_f", frame)
    return plan.select("stratum", "length_m", (F.col("length_m") / F.col("_f.m")).alias("share"), "points", F.try_divide("length_m", "points").alias("systematic_step_m"),
                       F.col("_f.m").alias("frame_m"), F.col("_f.c").alias("candidates"), (F.col("_f.m") - F.col("_f.c") * step).alias("excluded_m"))


# --- image window agreement -------------------------------------------------------------------
# Agreement tolerance and the lobe widths of the five nested bands, metres.
AGREEMENT_M = 0.5
BAND_LOBES_M = (0.05, 0.5, 1.0, 2.5, 10.0)


def _spread(bands: Column) -> Column:
    gap = lambda a, b: F.hypot(a["east"] - b["east"], a["north"] - b["north"])
    return F.array_max(F.flatten(F.transform(bands, lambda a: F.transform(bands, lambda b: gap(a, b)))))


def band_verdict(offsets: DataFrame, tolerance: float = AGREEMENT_M) -> DataFrame:
    """Per window: largest disagreement of the offsets over the bands that can resolve it.

    All bands present count, in band order; ``spread_n`` widens the set to the first n of them.
    A window with a band given twice or with fewer than two resolving bands has no verdict and
    says so in ``problem`` (see :func:`band_violations`).
    """
    entry = F.struct("band", "lobe_m", "east", "north")
    windows = offsets.groupBy("window_id").agg(F.sort_array(F.collect_list(entry)).alias("b"))
    resolving = F.filter("b", lambda x: x["lobe_m"] <= tolerance)
    problem = (F.when(F.size(F.array_distinct(F.transform("b", lambda x: x["band"]))) < F.size("b"), "duplicate_band")
               .when(F.size(resolving) < 2, "unresolved"))
    windows = windows.withColumn("problem", problem)
    sets = {f"spread_{n}": _spread(F.slice("b", 1, n)) for n in range(2, len(BAND_LOBES_M) + 1)}
    first = F.get("b", F.lit(0))
    rows = windows.withColumn("_r", F.when(F.col("problem").isNull(), resolving)).select("window_id", "problem", _spread(F.col("_r")).alias("spread"), F.hypot(first["east"], first["north"]).alias("offset_m"), *[v.alias(k) for k, v in sets.items()])
    return rows.withColumn("verdict", F.when(F.col("spread") <= tolerance, "consistent").when(F.col("problem").isNull(), "inconsistent"))


def band_violations(offsets: DataFrame, tolerance: float = AGREEMENT_M) -> DataFrame:
    """``window_id, problem`` of the windows that :func:`band_verdict` cannot judge."""
    return band_verdict(offsets, tolerance).where("problem is not null").select("window_id", "problem")


def band_summary(verdicts: DataFrame, tolerance: float = AGREEMENT_M) -> DataFrame:
    """Per nested band set: consistent windows, median and largest spread."""
    sets = F.explode(F.array(*[F.struct(F.lit(n).alias("bands"), F.col(f"spread_{n}").alias("s")) for n in range(2, len(BAND_LOBES_M) + 1)])).alias("x")
    long = verdicts.where("problem is null").select(sets).select("x.bands", "x.s")
    medians = exact_quantiles(long, ["bands"], "s", {"median_spread": 0.5})
    counts = long.groupBy("bands").agg(F.count_if(F.col("s") <= tolerance).alias("consistent"), F.count("*").alias("windows"), F.max("s").alias("max_spread"))
    return counts.join(medians, "bands")
