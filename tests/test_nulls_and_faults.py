"""Null keys and values, ties and faults: nothing may disappear unseen."""

import random

import pytest
from pyspark.sql import functions as F

from terrascreen.functions import text
from terrascreen.operators import compare, guards, keyed, linear, ordering, scoring, survey
from terrascreen.session import scratch_base
from terrascreen.sources import claims


def brute_midranks(rows):
    out = []
    for key, value in rows:
        mine = [v for k, v in rows if k == key]
        above = sum(v is not None and (value is None or v > value) for v in mine)
        out.append((str(key), str(value), above + (1 + sum(v == value for v in mine)) / 2))
    return sorted(out)


def test_midranks_keep_nulls_and_ties(frame):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1.0, 2.5])) for _ in range(120)]
    got = scoring.midranks(frame(rows, "k string, v double"), ["k"], "v")
    assert sorted((str(r["k"]), str(r["v"]), r["midrank"]) for r in got.collect()) == brute_midranks(rows)


def test_a_tie_of_nine_tenths_is_found_block_by_block(spark, frame):
    rows = [("a", 1.0 if i % 10 else float(i)) for i in range(400)]
    got = scoring.midranks(frame(rows, "k string, v double").repartition(8), ["k"], "v")
    assert sorted((str(r["k"]), str(r["v"]), r["midrank"]) for r in got.collect()) == brute_midranks(rows)


def test_positions_and_scans_keep_null_keys(frame):
    rows = [(None, 3), (None, 1), ("a", None), ("a", 5)]
    got = {(r["k"], r["v"]): r["rank"] for r in ordering.ordinal(frame(rows, "k string, v int"), ["k"], [F.col("v")]).collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", None): 1, ("a", 5): 2}
    spans = frame([(None, 0.0, 2.0), (None, 1.0, 3.0), ("r", 5.0, 6.0)], "route string, a double, b double")
    assert sorted(map(str, linear.interval_merge(spans, ["route"]).collect())) == sorted(["Row(route=None, a=0.0, b=3.0)", "Row(route='r', a=5.0, b=6.0)"])
    points = frame([(None, 1, "x"), (None, 2, "x"), (None, 3, None), ("g", 1, "y")], "gid string, pos int, v string")
    assert sorted((str(r["gid"]), r["run_start"], str(r["value"]), r["n"]) for r in linear.runs(points, ["gid"], "pos", F.col("v")).collect()) == [
        ("None", 1, "x", 2), ("None", 3, "None", 1), ("g", 1, "y", 1)]


def test_rank_comparison_counts_rows_with_a_null_side(frame):
    rows = frame([("a", 1.0, None, 1), ("b", 2.0, 5.0, 1), ("c", None, 4.0, 1)], "id string, a double, b double, k int")
    row = compare.compare_rankings(rows, []).first()
    assert row["n"] == 3 and row["exact_overlap"] == 1


def test_lookups_with_two_rows_for_a_key_fail(frame):
    near = frame([("t", None, None, 1.0)], "id string, district string, street string, distance_m double")
    assert keyed.heat_join(near, frame([("t", 5)], "id string, heat_pixel int")).first()["heat_pixel"] == 5
    with pytest.raises(Exception, match="several rows for t"):
        keyed.heat_join(near, frame([("t", 5), ("t", 6)], "id string, heat_pixel int")).collect()
    assert [(r["rule"], r["key"]) for r in guards.duplicate_keys(frame([("t",), ("t",), ("u",)], "id string"), ["id"]).collect()] == [("duplicate_key", "t")]


def test_a_kept_sample_without_its_rows_fails(frame):
    rows = frame([("a", 1), ("b", 2), ("c", 3)], "id string, ord int")
    kept = keyed.preserve_sample(rows, frame([("c", 1), ("a", 2)], "id string, ord int"))
    assert sorted((r["id"], r["committed_ord"]) for r in kept.collect()) == [("a", 2), ("c", 1)]
    gone = frame([("a", 1), ("x", 2), ("b", 3), ("b", 4)], "id string, ord int")
    with pytest.raises(Exception, match="no row for committed id x|several rows for b"):
        keyed.preserve_sample(rows, gone).collect()
    assert sorted((r["rule"], r["key"]) for r in guards.kept_sample_violations(rows, gone).collect()) == [("duplicate_committed", "b"), ("missing_id", "x")]
    assert keyed.preserve_sample(rows, None, 2).count() == 2


def test_short_routes_and_open_intervals_are_listed(frame):
    lengths = frame([("a", 1.0), ("b", 50.0), ("c", None), ("d", 250.0)], "gid string, route_m double")
    assert sorted((r["rule"], r["key"]) for r in guards.route_violations(lengths, 2.0, 100.0).collect()) == [
        ("no_length", "c"), ("shorter_than_step", "a"), ("shorter_than_window", "a"), ("shorter_than_window", "b")]
    assert {r["gid"]: (r["windows"], r["excluded_m"]) for r in guards.window_remainders(lengths.where("route_m > 0"), 100.0).collect()} == {"a": (0, 1.0), "b": (0, 50.0), "d": (2, 50.0)}
    spans = frame([("r", 2.0, 1.0), ("r", None, 1.0), ("r", 0.0, 1.0)], "route string, a double, b double")
    assert sorted((r["rule"], r["key"]) for r in guards.interval_violations(spans, ["route"]).collect()) == [("no_bound", "r:null"), ("reversed", "r:2.0")]


def test_bands_outside_the_usual_five_count_and_repeats_are_reported(frame):
    rows = [(1, b, w, 0.0, 0.0) for b, w in ((1, 0.05), (2, 0.5))] + [(1, 6, 0.3, 12.7, 0.0)]
    rows += [(2, 1, 0.05, 0.0, 0.0), (2, 1, 0.05, 1.0, 0.0), (2, 2, 0.5, 0.0, 0.0)] + [(3, 1, 0.05, 0.0, 0.0), (3, 4, 2.5, 0.0, 0.0)]
    offsets = frame(rows, "window_id int, band int, lobe_m double, east double, north double")
    got = {r["window_id"]: r for r in survey.band_verdict(offsets).collect()}
    assert got[1]["verdict"] == "inconsistent" and got[1]["spread"] == pytest.approx(12.7)
    assert got[2]["verdict"] is None and got[3]["verdict"] is None
    assert sorted((r["window_id"], r["problem"]) for r in survey.band_violations(offsets).collect()) == [(2, "duplicate_band"), (3, "unresolved")]


def test_leaving_out_a_null_group(frame):
    panel = frame([(c, g, float(c * 3 % 5 + i), float(c)) for c in range(8) for i, g in enumerate(("x", None))], "cell int, district string, fine double, seasonal double")
    got = {r["omitted"]: r for r in compare.leave_one_group_out(panel).collect()}
    assert set(got) == {"x", None} and all(r["n"] == 8 and r["sites"] == 8 for r in got.values())


def test_date_times_with_impossible_zones_are_refused(frame):
    cases = {"2024-02-29": True, "2024-02-30": False, "2024-01-01T00:00:00": True, "2024-01-01T00:00:00Z": True, "2024-01-01T00:00:00.5+0230": True, "2024-01-01T00:00:00+02:30": True,
             "2024-01-01T25:00:00": False, "2024-01-01T00:00:00.": False, "2024-01-01T00:00:00+99:00": False, "2024-01-01T00:00:00 Z": False, "": False, "2024-01-01T00:00": False}
    got = {r["v"]: r["ok"] for r in frame([(c,) for c in cases], "v string").select("v", text.is_iso8601(F.col("v")).alias("ok")).collect()}
    assert got == cases


def test_references_are_seen_from_their_document(frame):
    found = frame([("docs/a/x.md", t) for t in ("../b/y.md", "./x.md", "y.md", "z.md", "docs/b/", "../../docs/none", "/served")] + [("top.md", "./docs/b/y.md")], "name string, token string")
    lost = claims.misplaced_references(found, frame([("docs/a/x.md",), ("docs/b/y.md",)], "path string"))
    assert sorted(r["token"] for r in lost.collect()) == ["../../docs/none", "z.md"]


def test_scratch_lies_below_the_folder_the_session_names(spark):
    assert scratch_base(spark).startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/terrascreen-")
