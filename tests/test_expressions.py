"""Hand-computed values of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from terrascreen.functions import geo, numbers, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_scales_before_rounding_half_to_even(spark):
    assert value(spark, numbers.rounded(F.lit(1.015), 2)) == 1.01
    assert value(spark, numbers.rounded(F.lit(2.5), 0)) == 2.0


def test_weights(spark):
    def pair(a, b):
        h, p = numbers.weight_share(F.lit(a), F.lit(b))
        return spark.range(1).select(h.alias("h"), p.alias("p")).first()

    assert tuple(pair(float("nan"), float("inf"))) == (0.5, 0.5)
    assert tuple(pair(1e308, 1e308)) == (0.5, 0.5)
    assert tuple(pair(60.0, 40.0)) == (0.6, 0.4)


def test_spreadsheet_cells(spark):
    safe = lambda s: value(spark, text.spreadsheet_safe(F.lit(s)))
    assert safe("=1+1") == "'=1+1"
    assert safe("@SUM(A:A)") == "'@SUM(A:A)"
    assert safe("'=1+1") == "'=1+1"
    assert value(spark, text.spreadsheet_unescape(F.lit("'literal"))) is None
    assert value(spark, text.spreadsheet_unescape(F.lit("'=1+1"))) == "=1+1"


def test_dates(spark):
    assert str(value(spark, text.parse_slash_date(F.lit("2024/01/07 00:15")))) == "2024-01-07"
    with pytest.raises(Exception, match="invalid date"):
        value(spark, text.parse_slash_date(F.lit("2024/13/07")))
    assert value(spark, text.is_iso8601(F.lit("2026-10-16T13:41:13+02:00")))
    assert not value(spark, text.is_iso8601(F.lit("2026-02-30")))
    assert str(value(spark, text.decode_day_offset(F.lit("days since 2008-01-01"), F.lit(31)))) == "2008-02-01"


def test_numbers(spark):
    assert value(spark, numbers.to_number(F.lit("x"))) is None
    with pytest.raises(Exception, match="not a number"):
        value(spark, numbers.to_number_strict(F.lit("x")))


def test_equal_area_coordinates(spark):
    df = spark.createDataFrame([(50.839932, 4.342365), (52.0, 10.0)], "latitude double, longitude double")
    a, b = geo.with_laea(df).select("x", "y").collect()
    assert a == pytest.approx((3922928.318690623, 3096334.801671328), abs=1e-6)
    assert b == pytest.approx((4321000.0, 3210000.0), abs=1e-6)


def test_lambert_round_trip_and_raster(spark):
    df = spark.createDataFrame([(50.85, 4.35), (51.5, 4.35)], "latitude double, longitude double")
    planar = geo.with_lambert72(df)
    back = geo.with_wgs84(planar.drop("latitude", "longitude")).collect()
    assert (back[0]["latitude"], back[0]["longitude"]) == pytest.approx((50.85, 4.35), abs=1e-8)
    col, row = geo.pixel_index(F.col("x"), F.col("y"))
    inside = [r[0] for r in planar.select(geo.in_raster(col, row)).collect()]
    assert inside == [True, False]


def test_grid_snap(spark):
    assert value(spark, geo.grid_key(F.lit(50.85), F.lit(4.36))) == "50.75/4.25"
    assert value(spark, geo.grid_key(F.lit(50.90), F.lit(4.45))) == "51.0/4.5"


def test_axis_tie_takes_the_lower_index(spark):
    assert value(spark, geo.axis_index(F.lit(150.0), 0.0, 100.0, 301)) == 1
    assert value(spark, geo.axis_index(F.lit(-20.0), 0.0, 100.0, 301)) == 0


def test_sample_sizes(spark):
    size = lambda e, p, d: value(spark, numbers.required_sample_size(F.lit(e), F.lit(p), F.lit(d)))
    assert [size(.05, .5, 1.0), size(.10, .5, 1.0), size(.10, .1, 1.0), size(.075, .25, 1.0), size(.075, .25, 3.0)] == [385, 97, 35, 129, 385]
    assert size(.05, .5, .5) is None


def test_chance_overlap(spark):
    def chance(n, k, o):
        e, p = numbers.chance_overlap(F.lit(n), F.lit(k), F.lit(o))
        return spark.range(1).select(e.alias("e"), p.alias("p")).first()

    expected, tail = chance(100, 10, 7)
    assert expected == 1.0 and tail == pytest.approx(8.249e-7, rel=1e-3)
    expected, tail = chance(39, 10, 7)
    assert expected == pytest.approx(2.5641, abs=1e-4) and tail == pytest.approx(7.189e-4, rel=1e-3)
    assert chance(5, 5, 5)["p"] == pytest.approx(1.0)
    exact = sum(math.comb(30, o) * math.comb(970, 30 - o) for o in range(3, 31)) / math.comb(1000, 30)
    assert chance(1000, 30, 3)["p"] == pytest.approx(exact, rel=1e-9)
