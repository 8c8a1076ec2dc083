"""Slot gates, calendars, publication, readers and the violation rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from terrascreen.operators import quality, series
from terrascreen.sources import snapshots

DAY0 = dt.date(2024, 1, 1)


def window():
    return F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date")


def week(frame, feature="f", change=None, **values):
    rows = [[feature, DAY0 + dt.timedelta(days=d), s, float(values.get("cnt", 1)), float(values.get("speed", 10))] for d in range(7) for s in range(1, 97)]
    if change:
        change(rows)
    return frame([tuple(r) for r in rows], "feature string, obs_day date, slot int, cnt double, speed double")


def summary(frame, **kwargs):
    return series.slot_flow_summary(week(frame, **kwargs), *window()).first()


def test_slot_flow_reasons(frame):
    good = summary(frame)
    assert good["measured"] and good["mean_all"] == 1.0 and good["days"] == 7
    assert summary(frame, cnt=0)["reason"] == series.NO_MOVEMENT
    assert summary(frame, change=lambda r: r.__delitem__(slice(0, 300)))["reason"] == series.ROW_COUNT
    assert summary(frame, change=lambda r: r.append(list(r[-1])))["reason"] == series.ROW_COUNT
    assert summary(frame, change=lambda r: r[5].__setitem__(2, 1))["reason"] == series.SLOT_SET


def test_slot_gate(frame):
    rules = lambda df: {r["rule"] for r in series.slot_history_gate(df, *window()).collect()}
    assert rules(week(frame)) == set()
    assert rules(week(frame, cnt=0, speed=-1)) == {"zero_total", "no_speed"}
    one = lambda r: r[0].__setitem__(slice(3, 5), [1.0, 5.0])
    assert rules(week(frame, cnt=0, speed=-1, change=one)) == set()
    assert rules(week(frame, change=lambda r: r[3].__setitem__(2, 97))) == {"slot_set"}


def test_season_metrics_of_a_constant_and_a_rising_series(frame):
    rows = []
    for cell in ("flat", "rise"):
        for year in range(2015, 2018):
            day = dt.date(year, 1, 1)
            while day.year == year:
                v = 20.0 if cell == "flat" else (day - dt.date(year, 6, 1)).days * 0.1 + 20 + (year == 2016)
                rows.append((cell, day, v, v - 8))
                day += dt.timedelta(days=1)
    got = {r["cell"]: r for r in series.season_metrics(frame(rows, "cell string, obs_day date, val double, low double"), "2016-08-24", 30.0, 20.0).collect()}
    assert (got["flat"]["reference_rank"], got["flat"]["reference_percentile"], got["flat"]["hottest_year"]) == (1, 0.0, "2015")
    assert got["rise"]["hottest_year"] == "2016" and got["rise"]["reference_rank"] == 85 and got["rise"]["season_days"] == 276


def test_calendar_gaps(frame):
    rows = [("a", dt.date(2015, 1, 1) + dt.timedelta(days=i)) for i in range(365) if i != 40] + [("a", dt.date(2015, 3, 1))]
    got = {(str(r["obs_day"]), r["problem"]) for r in series.calendar_gaps(frame(rows, "cell string, obs_day date"), ["cell"], "obs_day").collect()}
    assert got == {("2015-02-10", "missing"), ("2015-03-01", "duplicate")}


def test_snapshot_files(spark, tmp_path):
    for name in ("a", "b"):
        body = {"feature": name, "start_date": "2024/01/01", "end_date": "2024/01/07", "records": [
            {"count_date": "2024/01/02", "time_gap": s, "count": s * 1.0, "average_speed": -1} for s in (1, 2, 3)]}
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    rows = snapshots.read_slot_history(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert rows.count() == 6 and rows.agg(F.sum("cnt")).first()[0] == 12.0
    sites = {"source": 2, "records": [{"id": "x", "latitude": 1.5}, {"id": "y", "latitude": None}]}
    (tmp_path / "sites.json").write_text(json.dumps(sites))
    got = snapshots.read_snapshot(spark, str(tmp_path / "sites.json"), snapshots.SITE_RECORD, "source BIGINT").orderBy("pos").collect()
    assert [(r["source"], r["pos"], r["id"], r["latitude"]) for r in got] == [(2, 0, "x", 1.5), (2, 1, "y", None)]


def test_rules_report_each_mutation(frame):
    rows = frame([("a", 1.0, 5), ("", 2.0, 101), ("b", 3.0, None), ("b", 3.0, 7)], "id string, v double, heat int")
    expected = frame([("a",), ("b",), ("c",)], "id string")
    found = {(r["rule"], r["key"]) for r in quality.dq_keys(rows, expected, F.lit(2)).collect()}
    assert found == {("empty_id", "1"), ("duplicate_id", "b"), ("missing_id", "c"), ("declared_total", "2")}
    assert {r["rule"] for r in quality.dq_ranges(rows, "id", {"heat": (1, 100)}).collect()} == {"heat_range"}
    assert quality.dq_ranges(rows, "id", {"heat": (1, 100)}).count() == 2
    with pytest.raises(ValueError, match="empty_id"):
        quality.enforce(quality.dq_keys(rows, expected))


def test_compare_tables(frame):
    stored = frame([(1, 5.0, "x"), (2, 6.0, None), (3, 1.0, "z")], "k int, v double, s string")
    fresh = frame([(1, 5.0000001, "x"), (2, 7.0, None), (4, 1.0, "z")], "k int, v double, s string")
    found = {(r["rule"], r["key"]) for r in quality.compare_tables(stored, fresh, ["k"], {"v": 1e-3, "s": None}).collect()}
    assert found == {("v", "2"), ("not_recomputed", "3"), ("not_stored", "4")}


def test_uniform_raster(frame):
    pixels = frame([(i, j, 7) for i in range(30) for j in range(30)], "col int, row int, value int")
    assert quality.dq_raster_uniform(pixels, 5, 7).count() == 1
    assert quality.dq_raster_uniform(pixels.withColumn("value", F.col("col")), 5, 7).count() == 0
