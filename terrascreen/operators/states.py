"""Season metrics from states per cell and year: a new year reads itself only, and states add up to what the whole series gives.

A state has counts, sums, extremes and the histogram of one season; a season is bounded by the calendar, so a state is bounded too. States are
kept as a table partitioned by year; a year that is loaded again replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded
from terrascreen.operators.series import SEASON_DAYS, season_rows

SCHEMA = ("cell long, n long, known long, days long, s double, s_low double, top double, bottom double, hot long, tropical long, ref double, "
          "histogram array<struct<val:double,n:long>>, yr int")


def season_states(daily: DataFrame, reference_day: str, hot: float, tropical: float) -> DataFrame:
    """One row per cell and year of ``cell, obs_day, val, low``; ``ref`` is the value of the reference day, in its own year only."""
    season = season_rows(daily)
    on_day = F.col("obs_day") == F.lit(reference_day).cast("date")
    whole = season.groupBy("cell", "yr").agg(
        F.count("*").alias("n"), F.count("val").alias("known"), F.countDistinct("obs_day").alias("days"), F.sum("val").alias("s"), F.sum("low").alias("s_low"), F.max("val").alias("top"), F.min("val").alias("bottom"),
        F.count_if(F.col("val") >= hot).alias("hot"), F.count_if(F.col("low") >= tropical).alias("tropical"), F.max(F.when(on_day, F.col("val"))).alias("ref"))
    counts = season.groupBy("cell", "yr", "val").agg(F.count("*").alias("n")).where(F.col("val").isNotNull())
    histogram = counts.groupBy("cell", "yr").agg(F.sort_array(F.collect_list(F.struct("val", "n"))).alias("histogram"))
    joined = whole.join(histogram, ["cell", "yr"], "left").withColumn("histogram", F.coalesce("histogram", F.array().cast("array<struct<val:double,n:bigint>>")))
    return joined.select(*[F.col(c.split()[0]).cast(c.split()[1]) if "histogram" not in c else F.col("histogram") for c in SCHEMA.split(", ")])


def store_states(states: DataFrame, path: str) -> None:
    """Adds states to a table; the years among them replace what the table has of these years, all others stay untouched."""
    states.repartition("yr", "cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yr").parquet(path)


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _with_reference(states: DataFrame) -> DataFrame:
    """States with the cell's reference value and, where there is one, the days of each season below it."""
    reference = states.groupBy("cell").agg(F.max("ref").alias("reference"))
    below = F.aggregate(F.filter("histogram", lambda h: h["val"] < F.col("reference")), F.lit(0).cast("bigint"), lambda total, h: total + h["n"])
    return states.join(reference, "cell").withColumns({"below": F.when(F.col("reference").isNotNull(), below), "mean": F.try_divide("s", "known")})


def _hottest() -> list[Column]:
    return [F.min_by("yr", F.struct(-F.col("mean"), F.col("yr"))).cast("string").alias("hottest_year"), rounded(F.max("mean"), 2).alias("hottest_year_mean")]


def season_metrics(states: DataFrame, reference_year: int, complete_only: bool = True) -> DataFrame:
    """What :func:`series.season_metrics` gives for the days behind the states."""
    of_year = lambda c: F.max(F.when(F.col("yr") == reference_year, F.col(c)))
    cells = _with_reference(states).groupBy("cell").agg(
        F.count("*").alias("seasons"), F.sum("n").alias("season_days"), F.min("n").alias("_min_n"), F.max("n").alias("_max_n"),
        rounded(F.sum("s") / F.sum("n"), 2).alias("seasonal_mean"), rounded(F.sum("s_low") / F.sum("n"), 2).alias("seasonal_low_mean"),
        rounded(F.max("mean") - F.min("mean"), 2).alias("spread_across_years"), *_hottest(), rounded(F.max("top"), 1).alias("warmest"),
        rounded(F.avg("hot"), 1).alias("hot_days_per_season"), rounded(F.avg("tropical"), 1).alias("tropical_nights_per_season"), rounded(F.max("reference"), 1).alias("reference_value"),
        rounded(of_year("mean"), 2).alias("reference_season_mean"), (of_year("below") + 1).alias("reference_rank"),
        rounded(100.0 * of_year("below") / of_year("n"), 1).alias("reference_percentile"), rounded(100.0 * F.sum("below") / F.sum("n"), 1).alias("window_percentile"))
    if complete_only:
        cells = cells.where((F.col("_min_n") == SEASON_DAYS) & (F.col("_max_n") == SEASON_DAYS))
    return cells.drop("_min_n", "_max_n")


def cube_season_metrics(states: DataFrame) -> DataFrame:
    """What :func:`series.cube_season_metrics` gives for the days behind the states."""
    counts = states.select("cell", F.explode("histogram").alias("h")).groupBy("cell", F.col("h.val").alias("val")).agg(F.sum("h.n").alias("n"))
    # A cell's distinct values are bounded by the days of its seasons.
    cell = Window.partitionBy("cell")
    ranked = counts.withColumns({"upto": F.sum("n").over(cell.orderBy("val")), "all": F.sum("n").over(cell)})
    p90 = ranked.where(F.col("upto") >= F.ceil(F.col("all") * 0.9)).groupBy("cell").agg(F.min("val").alias("p90"))
    cells = _with_reference(states).groupBy("cell").agg(
        F.count("*").alias("seasons"), F.sum("n").alias("n"), F.max("reference").alias("ref"), F.try_divide(F.sum("s"), F.sum("known")).alias("mean"), F.max("top").alias("top"),
        F.min("bottom").alias("bottom"), F.sum("hot").alias("hot"), F.sum("below").alias("below"), *_hottest())
    return cells.join(p90, "cell", "left").select(
        "cell", rounded("ref", 2).alias("reference_value"), rounded("mean", 2).alias("seasonal_mean"), rounded("top", 2).alias("seasonal_max"), rounded("p90", 2).alias("seasonal_p90"),
        rounded("bottom", 2).alias("seasonal_min"), rounded(F.col("hot") / F.col("seasons"), 2).alias("hot_days_per_season"), (F.col("below") + 1).alias("reference_rank"),
        rounded(100.0 * F.col("below") / F.col("n"), 1).alias("reference_percentile"), "hottest_year", "hottest_year_mean")


def state_problems(states: DataFrame) -> DataFrame:
    """What stops years from being pooled, from their states alone: cells without some year, years missing in between, dates met twice."""
    years = states.select("yr").distinct()
    bounds = years.agg(F.count("*").alias("years"), F.min("yr").alias("lo"), F.max("yr").alias("hi"))
    count = bounds.select("years").scalar()
    partial = states.groupBy("cell").agg(F.countDistinct("yr").alias("k")).withColumn("_y", count).where(F.col("k") != F.col("_y"))
    gaps = bounds.where("years > 0").select(F.explode(F.sequence("lo", "hi")).alias("yr")).join(years, "yr", "left_anti")
    named = lambda df, problem, key: df.select(F.lit(problem).alias("problem"), key.alias("key"))
    return (named(partial, "grid_differs", F.col("cell").cast("string")).unionByName(named(gaps, "year_missing", F.col("yr").cast("string")))
            .unionByName(named(states.where("n > days"), "duplicate_date", F.concat_ws(":", F.col("cell").cast("string"), F.col("yr").cast("string")))))
