"""Slot and daily series: calendars, quality gates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded
from terrascreen.functions.text import is_season
from terrascreen.operators.ordering import ordinal

# Slots per day in the source, the least total that counts as a measurement and
# the season length in days.
SLOTS_PER_DAY = 96
MINIMUM_TOTAL = 1.0
SEASON_DAYS = 92

NO_MOVEMENT = "no movement recorded"
ROW_COUNT = "unexpected number of slots"
SLOT_SET = "missing or duplicate slots"


def expected_grid(slots: DataFrame, feature: str, day: str, per_day: int) -> DataFrame:
    """Every (feature, day, slot) between the first and last day present."""
    bounds = slots.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("b"))
    features = slots.select(feature).distinct().withColumn("_b", bounds.scalar())
    days = features.select(feature, F.explode(F.sequence(F.col("_b.lo"), F.col("_b.hi"))).alias(day))
    return days.select(feature, day, F.explode(F.sequence(F.lit(1), F.lit(per_day))).alias("slot"))


def _per_day(slots: DataFrame, per_day: int, day_lo: Column, day_hi: Column) -> DataFrame:
    inside = F.col("obs_day").between(day_lo, day_hi)
    return slots.groupBy("feature", "obs_day").agg(
        F.count("*").alias("n_rows"), F.sum("cnt").alias("total"), F.avg("cnt").alias("day_mean"),
        F.countDistinct(F.when(F.col("slot").between(1, per_day), F.col("slot"))).alias("n_slots"),
        F.max(~inside).alias("outside"))


def slot_flow_summary(slots: DataFrame, first_day: Column, last_day: Column, per_day: int = SLOTS_PER_DAY) -> DataFrame:
    """Per feature: means, extremes of the daily means, and whether the window is a measurement.

    A window is unmeasured when it records no movement, when the row count differs from days
    times slots, or when any day lacks the full slot set; the reasons are tried in that order.
    Rows are aggregated per feature and day first, so the wide step is one row per day.
    """
    days = F.datediff(last_day, first_day) + 1
    daily = _per_day(slots, per_day, first_day, last_day)
    summary = daily.groupBy("feature").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("total").alias("observed_total"), F.count("*").alias("days"),
        F.sum("total").alias("_t"), F.min("day_mean").alias("_lo"), F.max("day_mean").alias("_hi"),
        F.min("n_slots").alias("_slots"), F.max("outside").alias("_outside"))
    expected = (days * per_day).cast("bigint")
    reason = (F.when(F.col("observed_total") < MINIMUM_TOTAL, NO_MOVEMENT)
              .when(F.col("n_rows") != expected, ROW_COUNT)
              .when((F.col("days") != days) | (F.col("_slots") != per_day) | F.col("_outside"), SLOT_SET))
    summary = summary.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return summary.select(
        "feature", "days", "observed_total", good.alias("measured"), "reason",
        F.when(good, rounded(F.col("_t") / F.col("n_rows"), 3)).alias("mean_all"),
        F.when(good, rounded("_lo", 3)).alias("min_day_mean"), F.when(good, rounded("_hi", 3)).alias("max_day_mean"))


def slot_history_gate(slots: DataFrame, first_day: Column, last_day: Column, per_day: int = SLOTS_PER_DAY) -> DataFrame:
    """Violations of the landing gate; needs columns feature, obs_day, slot, cnt, speed."""
    days = F.datediff(last_day, first_day) + 1
    daily = slots.groupBy("feature", "obs_day").agg(
        F.count("*").alias("n_rows"), F.countDistinct("slot").alias("n_slots"), F.sum("cnt").alias("total"),
        F.count_if(~F.coalesce(F.col("slot").between(1, per_day), F.lit(False))).alias("bad_slot"),
        F.count_if(~F.coalesce((F.col("cnt") >= 0) & ~F.isnan("cnt"), F.lit(False))).alias("bad_count"),
        F.count_if(F.coalesce(F.col("speed") >= 0, F.lit(False))).alias("with_speed"),
        F.count_if(~F.col("obs_day").between(first_day, last_day)).alias("outside"))
    whole = daily.groupBy("feature").agg(
        F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_days"), F.sum("outside").alias("outside"),
        F.count_if((F.col("n_rows") != per_day)).alias("bad_days"),
        F.count_if((F.col("n_slots") != per_day) | (F.col("bad_slot") > 0)).alias("bad_slots"),
        F.sum("bad_count").alias("bad_count"), F.sum("total").alias("total"), F.sum("with_speed").alias("with_speed"))
    checks = [
        ("row_count", F.col("n_rows") != days * per_day), ("day_coverage", (F.col("n_days") != days) | (F.col("outside") > 0)),
        ("rows_per_day", F.col("bad_days") > 0), ("slot_set", F.col("bad_slots") > 0), ("count_value", F.col("bad_count") > 0),
        ("zero_total", F.col("total") < MINIMUM_TOTAL), ("no_speed", F.col("with_speed") == 0)]
    return violations(whole, F.col("feature"), checks)


def violations(df: DataFrame, key: Column, checks: list[tuple[str, Column]]) -> DataFrame:
    """Long table (rule, key): one row per failed check; a null check counts as failed."""
    flags = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in checks])
    return df.select(F.explode(F.array_compact(flags)).alias("rule"), key.cast("string").alias("key"))


def history_stats(slots: DataFrame, summary: DataFrame) -> DataFrame:
    """Pooled statistics over the measured features: one row, null when none is measured."""
    measured = summary.where("measured").select("feature")
    pooled = slots.join(measured, "feature", "left_semi").agg(
        F.count("*").alias("observations"), rounded(F.avg("cnt"), 1).alias("mean_count"),
        F.rint(F.max("cnt")).cast("bigint").alias("max_count"))
    features = summary.agg(F.count_if(F.col("measured")).alias("m"), F.count_if(~F.col("measured")).alias("u"))
    counts = features.select(F.struct("m", "u").alias("c"))
    return pooled.withColumn("_c", counts.scalar()).select(
        "observations", "mean_count", "max_count", F.col("_c.m").alias("measured_features"), F.col("_c.u").alias("unmeasured_features"))


def station_rows(summary: DataFrame) -> DataFrame:
    """Features by descending mean, then name, numbered; unmeasured ones have no number and no mean.

    The list of features is bounded by the stations of a network, and numbering keeps any size.
    """
    ranked = ordinal(summary.where("measured").select("feature", "mean_all", "min_day_mean", "max_day_mean"), [], [F.desc("mean_all"), F.col("feature")], "place")
    rest = summary.where("not measured").select("feature", *[F.lit(None).cast("double").alias(c) for c in ("mean_all", "min_day_mean", "max_day_mean")], F.lit(None).cast("bigint").alias("place"))
    return ranked.select(*rest.columns).unionByName(rest)


def flow_context(sites: DataFrame, summary: DataFrame) -> DataFrame:
    """Site rows with the flow of their station; the mean is null unless the station is measured."""
    flow = summary.select(F.col("feature").alias("nearest_station"), F.col("measured").alias("_m"), F.col("mean_all").alias("_f"))
    joined = sites.join(flow, "nearest_station", "left")
    measured = F.coalesce(F.col("_m"), F.lit(False))
    return joined.select(*sites.columns, F.when(measured, F.col("_f")).alias("flow_mean"), measured.alias("has_flow"))


def stations_without_flow(context: DataFrame) -> DataFrame:
    """Distinct non-blank stations of sites that have no measured flow."""
    return (context.where(~F.col("has_flow") & (F.coalesce("nearest_station", F.lit("")) != ""))
            .select("nearest_station").distinct())


def calendar_gaps(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Days absent from the whole calendar years a key covers, and days recorded more than once."""
    counted = days.groupBy(*keys, day).agg(F.count("*").alias("n"))
    years = counted.select(*keys, F.year(day).alias("yr")).distinct()
    full = years.select(*keys, F.explode(F.sequence(F.make_date("yr", F.lit(1), F.lit(1)), F.make_date("yr", F.lit(12), F.lit(31)))).alias(day))
    missing = full.join(counted, [*keys, day], "left_anti").select(*keys, day, F.lit("missing").alias("problem"))
    repeated = counted.where("n > 1").select(*keys, day, F.lit("duplicate").alias("problem"))
    return missing.unionByName(repeated)


def season_rows(daily: DataFrame, day: str = "obs_day") -> DataFrame:
    """June to August rows with their year."""
    return daily.where(is_season(F.col(day))).withColumn("yr", F.year(day))


def season_metrics(daily: DataFrame, reference_day: str, hot: float, tropical: float, complete_only: bool = True) -> DataFrame:
    """Per cell: pooled season metrics from daily columns ``val`` (maximum) and ``low`` (minimum).

    Everything is a two-level aggregate (cell and year, then cell); the reference day value is
    joined back per cell, a calendar-bounded table; a cell without that day keeps its other
    metrics. ``guards.season_violations`` lists incomplete seasons, which ``complete_only`` leaves out.
    """
    season = season_rows(daily)
    reference_year = int(reference_day[:4])
    reference = daily.where(F.col("obs_day") == F.lit(reference_day).cast("date")).groupBy("cell").agg(F.max("val").alias("ref"))
    season = season.join(reference, "cell", "left")
    in_year = F.col("yr") == reference_year
    yearly = season.groupBy("cell", "yr").agg(
        F.avg("val").alias("year_mean"), F.sum("val").alias("s"), F.sum("low").alias("s_low"), F.count("*").alias("n"),
        F.max("val").alias("top"), F.count_if(F.col("val") >= hot).alias("hot"), F.count_if(F.col("low") >= tropical).alias("trop"),
        F.when(F.max("ref").isNotNull(), F.count_if(F.col("val") < F.col("ref"))).alias("below"), F.max("ref").alias("ref"))
    cells = yearly.groupBy("cell").agg(
        F.count("*").alias("seasons"), F.sum("n").alias("season_days"), F.min("n").alias("_min_n"), F.max("n").alias("_max_n"),
        rounded(F.sum("s") / F.sum("n"), 2).alias("seasonal_mean"), rounded(F.sum("s_low") / F.sum("n"), 2).alias("seasonal_low_mean"),
        rounded(F.max("year_mean") - F.min("year_mean"), 2).alias("spread_across_years"),
        F.min_by("yr", F.struct(-F.col("year_mean"), F.col("yr"))).cast("string").alias("hottest_year"),
        rounded(F.max("year_mean"), 2).alias("hottest_year_mean"), rounded(F.max("top"), 1).alias("warmest"),
        rounded(F.avg("hot"), 1).alias("hot_days_per_season"), rounded(F.avg("trop"), 1).alias("tropical_nights_per_season"),
        rounded(F.max("ref"), 1).alias("reference_value"),
        rounded(F.max(F.when(in_year, F.col("year_mean"))), 2).alias("reference_season_mean"),
        (F.max(F.when(in_year, F.col("below"))) + 1).alias("reference_rank"),
        rounded(100.0 * F.max(F.when(in_year, F.col("below"))) / F.max(F.when(in_year, F.col("n"))), 1).alias("reference_percentile"),
        rounded(100.0 * F.sum("below") / F.sum("n"), 1).alias("window_percentile"))
    if complete_only:
        cells = cells.where((F.col("_min_n") == SEASON_DAYS) & (F.col("_max_n") == SEASON_DAYS))
    return cells.drop("_min_n", "_max_n")


def cube_season_metrics(daily: DataFrame, reference_day: str, hot: float) -> DataFrame:
    """Per cell over all pooled seasons: mean, extremes, nearest-rank p90, ranks, hottest season.

    A cell's pooled season is bounded by the calendar, so the percentile state is bounded too.
    """
    season = season_rows(daily)
    reference = daily.where(F.col("obs_day") == F.lit(reference_day).cast("date")).groupBy("cell").agg(F.max("val").alias("ref"))
    season = season.join(reference, "cell", "left")
    yearly = season.groupBy("cell", "yr").agg(F.avg("val").alias("m"))
    hottest = yearly.groupBy("cell").agg(
        F.count("*").alias("seasons"), F.min_by("yr", F.struct(-F.col("m"), F.col("yr"))).cast("string").alias("hottest_year"),
        rounded(F.max("m"), 2).alias("hottest_year_mean"))
    pooled = season.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("ref").alias("ref"), F.avg("val").alias("mean"), F.max("val").alias("top"), F.min("val").alias("bottom"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY val)").alias("p90"), F.count_if(F.col("val") >= hot).alias("hot"),
        F.when(F.max("ref").isNotNull(), F.count_if(F.col("val") < F.col("ref"))).alias("below"))
    return pooled.join(hottest, "cell").select(
        "cell", rounded("ref", 2).alias("reference_value"), rounded("mean", 2).alias("seasonal_mean"), rounded("top", 2).alias("seasonal_max"),
        rounded("p90", 2).alias("seasonal_p90"), rounded("bottom", 2).alias("seasonal_min"),
        rounded(F.col("hot") / F.col("seasons"), 2).alias("hot_days_per_season"), (F.col("below") + 1).alias("reference_rank"),
        rounded(100.0 * F.col("below") / F.col("n"), 1).alias("reference_percentile"), "hottest_year", "hottest_year_mean")
