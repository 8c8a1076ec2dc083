"""States per cell and year against the whole series, and feature files whose row groups are left out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrascreen.operators import series, states
from terrascreen.sources import snapshots, spatial_files

REFERENCE, HOT, TROPICAL = "2019-07-25", 25.0, 16.0
LAYOUT = "cell int, obs_day date, val double, low double"


def days(years, cells=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for cell in range(cells):
        for year in years:
            for n in range(365):
                day = dt.date(year, 1, 1) + dt.timedelta(days=n)
                value = round(rng.uniform(10, 35), rng.choice((0, 2)))
                rows.append((cell, day, value, round(value - rng.uniform(2, 12), 2)))
    return rows


def stored(frame, spark, path, *parts):
    for rows in parts:
        states.store_states(states.season_states(frame(rows, LAYOUT), REFERENCE, HOT, TROPICAL), path)
    return states.stored_states(spark, path)


def same(left, right):
    return left.columns == right.columns and sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.mark.parametrize("years", [(2017, 2018, 2019, 2020), (2017, 2018)])
def test_years_one_by_one_equal_the_whole_series(frame, spark, tmp_path, years):
    rows = days(years)
    kept = stored(frame, spark, str(tmp_path / "s"), *[[r for r in rows if r[1].year == y] for y in years])
    whole = frame(rows, LAYOUT)
    assert kept.count() == 4 * len(years)
    assert same(states.season_metrics(kept, 2019), series.season_metrics(whole, REFERENCE, HOT, TROPICAL).select(*states.season_metrics(kept, 2019).columns))
    assert same(states.cube_season_metrics(kept), series.cube_season_metrics(whole, REFERENCE, HOT))
    assert states.state_problems(kept).count() == 0


def test_a_year_loaded_again_replaces_only_itself(frame, spark, tmp_path):
    path, first, second = str(tmp_path / "s"), days((2018,), seed=3), days((2019,), seed=4)
    stored(frame, spark, path, first, days((2019,), seed=9))
    before = {f.name for f in (tmp_path / "s" / "yr=2018").iterdir()}
    kept = stored(frame, spark, path, second)
    assert {f.name for f in (tmp_path / "s" / "yr=2018").iterdir()} == before
    assert same(states.cube_season_metrics(kept), series.cube_season_metrics(frame(first + second, LAYOUT), REFERENCE, HOT))


def test_problems_are_seen_in_states(frame, spark, tmp_path):
    rows = [r for r in days((2017, 2018, 2020)) if not (r[0] == 2 and r[1].year == 2018)]
    rows.append((3, dt.date(2020, 7, 1), 1.0, 0.0))
    kept = stored(frame, spark, str(tmp_path / "s"), rows)
    assert {(r["problem"], r["key"]) for r in states.state_problems(kept).collect()} == {("grid_differs", "2"), ("year_missing", "2019"), ("duplicate_date", "3:2020")}
    assert states.season_metrics(kept, 2019).where("cell = 3").count() == 0


def test_nulls_and_nothing(frame, spark, tmp_path):
    rows = [(1, dt.date(2019, 7, d), None if d == 3 else float(d), None) for d in range(1, 20)] + [(1, dt.date(2019, 1, 1), 99.0, 0.0)]
    kept = stored(frame, spark, str(tmp_path / "s"), rows)
    assert same(states.cube_season_metrics(kept), series.cube_season_metrics(frame(rows, LAYOUT), REFERENCE, HOT))
    assert stored(frame, spark, str(tmp_path / "n"), [r for r in rows if r[1].month == 1]).count() == 0


def scanned(df):
    """Rows that the scan of a filtered table hands on, after whole row groups have been left out."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_window_test_leaves_out_row_groups(frame, spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, x := rng.uniform(0, 1000), y := rng.uniform(0, 1000), x + rng.uniform(0, 3), y + rng.uniform(0, 3)) for i in range(40_000)]
    rows += [(100_000 + i, float(i), 0.0, float(i) + 900, 1000.0) for i in range(5)]
    features = frame(rows, "poly_id int, x1 double, y1 double, x2 double, y2 double").repartition(4)
    bounds = (100.0, 100.0, 160.0, 180.0)
    spatial_files.write_features(features, str(tmp_path / "curve"), group_bytes=16_384)
    features.write.option("parquet.block.size", 16_384).parquet(str(tmp_path / "plain"))
    results, read = {}, {}
    for name in ("curve", "plain"):
        found = snapshots.bbox_extract(spark.read.parquet(str(tmp_path / name)), bounds)
        results[name], read[name] = sorted(map(tuple, found.collect())), scanned(found)
    wanted = sorted(r for r in rows if r[3] >= 100 and r[1] <= 160 and r[4] >= 100 and r[2] <= 180)
    assert results["curve"] == results["plain"] == wanted
    assert read["plain"] > 30_000 and read["curve"] < read["plain"] / 5


def test_curve_keeps_every_row(frame, tmp_path, spark):
    rows = [(1, 0.0, 0.0, 0.0, 0.0), (2, None, 1.0, 2.0, 3.0), (3, 5.0, 5.0, 5.0, 5.0), (3, 5.0, 5.0, 5.0, 5.0)]
    table = frame(rows, "poly_id int, x1 double, y1 double, x2 double, y2 double")
    spatial_files.write_features(table, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect())) and back.columns == table.columns
    assert spatial_files.curve_order(table.where(F.lit(False))).count() == 0
