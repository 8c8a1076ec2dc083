"""What an operator cannot use, as tables: one row per problem, so nothing disappears unseen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.operators.series import season_rows, violations

SEASON_DAYS = 92


def _key(names: Sequence[str]):
    return F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names])


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that several rows share (``rule, key``); nulls count as one value."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return many.select(F.lit("duplicate_key").alias("rule"), _key(keys).alias("key"))


def unique_lookup(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` as a lookup table: fails where a key has several rows, since a join would multiply its left side.

    The grouping is the shuffle that the join on the same keys needs anyway.
    """
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    problem = F.raise_error(F.concat(F.lit("several rows for "), _key(keys)))
    first = grouped.schema[columns[0]].dataType if columns else None
    checked = {columns[0]: F.when(F.col("_n") == 1, F.col(columns[0])).otherwise(problem.cast(first))} if columns else {}
    return grouped.withColumns(checked).drop("_n")


def route_violations(lengths: DataFrame, step: float, window_m: float, keys: Sequence[str] = ("gid",)) -> DataFrame:
    """Routes without a usable length, and those too short for one grid step or one window."""
    length = F.col("route_m")
    unusable = length.isNull() | F.isnan(length) | (length <= 0)
    return violations(lengths, _key(keys), [("no_length", unusable), ("shorter_than_step", ~unusable & (length < step)), ("shorter_than_window", ~unusable & (length < window_m))])


def selection_violations(features: DataFrame, request: DataFrame, crs: str, frame: Sequence[float]) -> DataFrame:
    """What makes a retrieved set of routes unfit for selection (``rule, key``; no rows: fit).

    ``features`` has ``gid`` and ``crs`` per retrieved route; ``request`` is the row of the request: ``number_matched`` (counted apart),
    ``number_returned``, ``response_count``, ``response_cap``, ``crs`` and the bounds ``x0, y0, x1, y1`` that were asked for. All counts must be
    the number of rows, which must stay below the cap; ids must be there and differ; every CRS must be ``crs`` and the bounds ``frame``.
    """
    rows = features.agg(F.count("*").alias("n")).scalar()
    asked = request.withColumn("_n", rows)
    differs = lambda name: ~F.col(name).eqNullSafe(F.col("_n"))
    moved = F.lit(False)
    for name, value in zip(("x0", "y0", "x1", "y1"), frame):
        moved = moved | ~F.col(name).eqNullSafe(F.lit(float(value)))
    counts = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("number_matched", "number_returned", "response_count", "_n")])
    whole = violations(asked, counts, [
        ("count_differs", differs("number_matched") | differs("number_returned") | differs("response_count")), ("possibly_truncated", F.col("_n") >= F.col("response_cap")),
        ("request_crs", ~F.col("crs").eqNullSafe(F.lit(crs))), ("frame_changed", moved)])
    requests = request.agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("not_one_request").alias("rule"), F.col("n").cast("string").alias("key"))
    other = violations(features, _key(["gid"]), [("missing_id", F.col("gid").isNull()), ("other_crs", ~F.col("crs").eqNullSafe(F.lit(crs)))])
    twice = duplicate_keys(features.where("gid is not null"), ["gid"])
    return whole.unionByName(requests).unionByName(other).unionByName(twice)


def empty_selection(selected: DataFrame) -> DataFrame:
    """One row if nothing was selected."""
    return selected.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_selection").alias("rule"), F.lit("0").alias("key"))


def interval_violations(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals that end before they start, and those without a bound."""
    open_ended = F.col("a").isNull() | F.col("b").isNull() | F.isnan("a") | F.isnan("b")
    label = F.concat_ws(":", _key(keys), F.coalesce(F.col("a").cast("string"), F.lit("null")))
    return violations(intervals, label, [("no_bound", open_ended), ("reversed", ~open_ended & (F.col("b") < F.col("a")))])


def season_violations(daily: DataFrame, reference_day: str) -> DataFrame:
    """Cell seasons with missing or repeated days, and cells without a value on the reference day."""
    days = season_rows(daily).groupBy("cell", "yr").agg(F.count("*").alias("n"), F.countDistinct("obs_day").alias("d"))
    short = violations(days, _key(["cell", "yr"]), [("missing_days", F.col("d") < SEASON_DAYS), ("repeated_days", F.col("n") > F.col("d"))])
    on_day = F.max(F.when(F.col("obs_day") == F.lit(reference_day).cast("date"), F.col("val")))
    cells = daily.groupBy("cell").agg(on_day.alias("ref"))
    return short.unionByName(violations(cells, _key(["cell"]), [("no_reference_day", F.col("ref").isNull())]))


def kept_sample_violations(rows: DataFrame, committed: DataFrame) -> DataFrame:
    """Committed ids that the source no longer has, and ids given twice on either side."""
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"), _key(["id"]).alias("key"))
    lost = committed.join(rows.select("id"), "id", "left_anti")
    twice = lambda df: df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    used = rows.join(committed.select("id"), "id", "left_semi")
    return named(lost, "missing_id").unionByName(named(twice(committed), "duplicate_committed")).unionByName(named(twice(used), "duplicate_source"))


def window_remainders(lengths: DataFrame, window_m: float, keys: Sequence[str] = ("gid",)) -> DataFrame:
    """Per route: full windows from each end and the length that no window covers, routes under one window included."""
    count = F.floor(F.col("route_m") / window_m)
    return lengths.select(*keys, "route_m", count.cast("bigint").alias("windows"), (F.col("route_m") - count * window_m).alias("excluded_m"))
