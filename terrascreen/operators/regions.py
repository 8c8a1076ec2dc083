"""Summaries over cells, reports built on them, and packed daily cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded
from terrascreen.functions.text import decode_day_offset, decode_packed
from terrascreen.operators.series import calendar_gaps, season_rows


def region_summary(cells: DataFrame) -> DataFrame:
    """One row over cell metrics: extremes, spread and means."""
    spread = lambda c: rounded(F.max(c) - F.min(c), 2)
    return cells.agg(
        F.count("*").alias("cells"), F.min("reference_value").alias("reference_min"), F.max("reference_value").alias("reference_max"), spread("reference_value").alias("reference_spread"),
        F.min("seasonal_mean").alias("seasonal_min"), F.max("seasonal_mean").alias("seasonal_max"), spread("seasonal_mean").alias("seasonal_spread"),
        F.min("hot_days_per_season").alias("hot_days_min"), F.max("hot_days_per_season").alias("hot_days_max"),
        F.min("reference_percentile").alias("percentile_min"), F.max("reference_percentile").alias("percentile_max"), rounded(F.avg("reference_percentile"), 1).alias("percentile_mean"))


def season_context(cells: DataFrame) -> DataFrame:
    """Report row: hottest years in order, mean of the hottest means, reference rank range.

    The year list is bounded by the seasons of the window.
    """
    return cells.agg(
        F.concat_ws(",", F.sort_array(F.collect_set("hottest_year"))).alias("hottest_years"), rounded(F.avg("hottest_year_mean"), 2).alias("hottest_mean"),
        rounded(F.avg("reference_season_mean"), 2).alias("reference_season_mean"), F.min("reference_rank").alias("rank_min"), F.max("reference_rank").alias("rank_max"),
        F.min("hot_days_per_season").alias("hot_days_min"), F.max("hot_days_per_season").alias("hot_days_max"))


def reference_rank(daily: DataFrame, reference_day: str) -> DataFrame:
    """Per cell and season: rank of the reference day from the cool side and its percentile."""
    season = season_rows(daily)
    reference = daily.where(F.col("obs_day") == F.lit(reference_day).cast("date")).groupBy("cell").agg(F.max("val").alias("ref"))
    counts = season.join(reference, "cell").groupBy("cell", "yr").agg(F.count_if(F.col("val") < F.col("ref")).alias("below"), F.count("*").alias("n"))
    return counts.select("cell", "yr", (F.col("below") + 1).alias("rank"), rounded(100.0 * F.col("below") / F.col("n"), 1).alias("percentile"))


def argmax_year(daily: DataFrame) -> DataFrame:
    """Per cell: the season with the highest mean, ties to the earliest."""
    yearly = season_rows(daily).groupBy("cell", "yr").agg(F.avg("val").alias("m"))
    return yearly.groupBy("cell").agg(F.min_by("yr", F.struct(-F.col("m"), F.col("yr"))).cast("bigint").alias("hottest_year"), F.max("m").alias("mean"))


def mean_max_cells(pairs: DataFrame, reference_day: str, year: int) -> DataFrame:
    """Per cell: reference-day and season values of the daily mean and maximum, with differences."""
    on_day = F.col("obs_day") == F.lit(reference_day).cast("date")
    season = F.month("obs_day").isin(6, 7, 8) & (F.year("obs_day") == year)
    wide = pairs.groupBy("cell").agg(
        F.max(F.when(on_day, F.col("first_val"))).alias("mean_ref"), F.max(F.when(on_day, F.col("second_val"))).alias("max_ref"),
        F.avg(F.when(season, F.col("first_val"))).alias("mean_season"), F.avg(F.when(season, F.col("second_val"))).alias("max_season"), F.count_if(season).alias("season_days"))
    return wide.withColumns({"ref_delta": F.col("max_ref") - F.col("mean_ref"), "season_delta": F.col("max_season") - F.col("mean_season")})


MEAN_MAX_PAIRS = {"reference_mean_vs_maximum": ("mean_ref", "max_ref"), "season_mean_vs_maximum": ("mean_season", "max_season"),
                  "mean_reference_vs_season": ("mean_ref", "mean_season"), "maximum_reference_vs_season": ("max_ref", "max_season")}


def mean_max_pairs(cells: DataFrame) -> DataFrame:
    """The four compared pairs as rows (comparison, cell, a, b)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b")) for n, (a, b) in MEAN_MAX_PAIRS.items()])).alias("p")
    return cells.select("cell", pairs).select("cell", "p.comparison", "p.a", "p.b")


def decode_cube(raw: DataFrame, units: str, sentinels: list[float], scale: float, offset: float) -> DataFrame:
    """Packed long cube (cell, day_offset, raw) to dates and physical values."""
    day = decode_day_offset(F.lit(units), F.col("day_offset"))
    return raw.withColumns({"obs_day": day, "val": decode_packed(F.col("raw"), sentinels, scale, offset)})


def pool_problems(years: DataFrame, cells: list[str], year: str = "yr", day: str = "obs_day") -> DataFrame:
    """What stops annual cubes from being pooled: a grid that differs between years, gaps between
    years, or a date recorded twice in a cell."""
    grid = years.select(*cells, year).distinct()
    n_years = years.select(year).distinct().agg(F.count("*")).scalar()
    partial = grid.groupBy(*cells).agg(F.count("*").alias("n")).withColumn("_y", n_years).where(F.col("n") != F.col("_y"))
    moved = partial.select(F.lit("grid_differs").alias("problem"), F.concat_ws(":", *[F.col(c).cast("string") for c in cells]).alias("key"))
    listed = years.select(F.col(year).alias("y")).distinct()
    bounds = listed.agg(F.struct(F.min("y").alias("lo"), F.max("y").alias("hi")).alias("b"))
    expected = bounds.select(F.explode(F.sequence("b.lo", "b.hi")).alias("y"))
    gaps = expected.join(listed, "y", "left_anti").select(F.lit("year_missing").alias("problem"), F.col("y").cast("string").alias("key"))
    repeated = years.groupBy(*cells, day).agg(F.count("*").alias("n")).where("n > 1")
    twice = repeated.select(F.lit("duplicate_date").alias("problem"), F.concat_ws(":", *[F.col(c).cast("string") for c in cells], F.col(day).cast("string")).alias("key"))
    return moved.unionByName(gaps).unionByName(twice)


__all__ = ["argmax_year", "calendar_gaps", "decode_cube", "mean_max_cells", "mean_max_pairs", "pool_problems", "reference_rank", "region_summary", "season_context"]
