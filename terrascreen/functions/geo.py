"""Coordinates: distances, map projections and grids.

Projections are closed expressions without iteration: an iterated formula doubles the expression
tree with every step once the optimiser pushes a filter on its result through the projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0

# Study envelope in degrees (inclusive).
ENVELOPE = {"lat_min": 50.7, "lat_max": 51.0, "lon_min": 4.1, "lon_max": 4.7}


def in_envelope(latitude: Column, longitude: Column) -> Column:
    e = ENVELOPE
    inside = latitude.between(e["lat_min"], e["lat_max"]) & longitude.between(e["lon_min"], e["lon_max"])
    return F.coalesce(inside, F.lit(False))


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin((F.radians(lat_b) - F.radians(lat_a)) / 2)
    half_lon = F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a one-row ``inline``, which stays in generated code.

    The optimiser neither merges nor pushes filters through it, so a long expression is computed
    once per row however often its result is used.
    """
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(fields)))


# --- Belgian Lambert 72 (EPSG:31370) ----------------------------------------------------------
# Published ellipsoids, seven-parameter datum shift and two-parallel cone.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
INTL_A, INTL_F = 6378388.0, 1 / 297.0
SHIFT_M = (-106.8686, 52.2978, -103.7239)
SHIFT_ROTATION = tuple(math.radians(v / 3600) for v in (0.3366, -0.457, 1.8422))
SHIFT_SCALE = -1.2747e-6
CONE_LON0 = math.radians(4.367486666666666)
CONE_LAT1, CONE_LAT2 = math.radians(49.8333339), math.radians(51.16666723333333)
CONE_X0, CONE_Y0 = 150000.013, 5400088.438
# Raster origin (upper left corner), pixel size and shape.
RASTER_X, RASTER_Y, PIXEL_M = 140000.0, 178000.0, 2.0
RASTER_COLUMNS, RASTER_ROWS = 10_000, 9_000

_INTL_E = math.sqrt(INTL_F * (2 - INTL_F))


def _cone_m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_INTL_E * math.sin(lat)) ** 2)


def _cone_t(lat: float) -> float:
    es = _INTL_E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - es) / (1 + es)) ** (_INTL_E / 2)


CONE_N = math.log(_cone_m(CONE_LAT1) / _cone_m(CONE_LAT2)) / math.log(_cone_t(CONE_LAT1) / _cone_t(CONE_LAT2))
CONE_SCALE = INTL_A * _cone_m(CONE_LAT1) / (CONE_N * _cone_t(CONE_LAT1) ** CONE_N)
CONE_RHO0 = CONE_SCALE * max(_cone_t(math.radians(90.0)), 0.0) ** CONE_N


def shift_matrix() -> list[list[float]]:
    """Linear part of the datum shift from the local ellipsoid to WGS84."""
    rx, ry, rz = SHIFT_ROTATION
    s = 1 + SHIFT_SCALE
    return [[s, -rz, ry], [rz, s, -rx], [-ry, rx, s]]


def inverse_3x3(m: list[list[float]]) -> list[list[float]]:
    """Inverse by cofactors; computed once in Python and folded into the plan as literals."""
    def minor(i, j):
        rows = [r for k, r in enumerate(m) if k != i]
        (a, b), (c, d) = [[v for k, v in enumerate(r) if k != j] for r in rows]
        return a * d - b * c

    det = sum((-1) ** j * m[0][j] * minor(0, j) for j in range(3))
    return [[(-1) ** (i + j) * minor(j, i) / det for j in range(3)] for i in range(3)]


def _ecef(lat: Column, lon: Column, a: float, f: float) -> list[Column]:
    e2 = f * (2 - f)
    radius = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin(lat) * F.sin(lat))
    return [radius * F.cos(lat) * F.cos(lon), radius * F.cos(lat) * F.sin(lon), radius * F.lit(1 - e2) * F.sin(lat)]


def _linear(matrix, vector: list[Column]) -> list[Column]:
    return [sum((F.lit(row[i]) * vector[i] for i in range(1, 3)), F.lit(row[0]) * vector[0]) for row in matrix]


def _tan_latitude(vector: list[Column], a: float, f: float) -> Column:
    """Tangent of the geodetic latitude of a Cartesian point (one-step formula, sub-micrometre near the surface)."""
    x, y, z = vector
    e2 = f * (2 - f)
    b = a * (1 - f)
    beta = F.atan2(z * F.lit(a), F.sqrt(x * x + y * y) * F.lit(b))
    horizontal = F.sqrt(x * x + y * y) - F.lit(e2 * a) * F.pow(F.cos(beta), F.lit(3.0))
    return (z + F.lit(e2 / (1 - e2) * b) * F.pow(F.sin(beta), F.lit(3.0))) / horizontal


def _latitude_series(terms: int = 7, samples: int = 512) -> list[float]:
    """Sine coefficients of geodetic minus conformal latitude, by the trapezoid rule.

    The integrand is smooth and periodic, so the sums are exact to rounding.
    """
    def gap(chi: float) -> float:
        phi = chi
        for _ in range(30):
            es = _INTL_E * math.sin(phi)
            phi = 2 * math.atan(math.tan(math.pi / 4 + chi / 2) * ((1 + es) / (1 - es)) ** (_INTL_E / 2)) - math.pi / 2
        return phi - chi

    points = [math.pi * (i + 0.5) / samples - math.pi / 2 for i in range(samples)]
    values = [gap(c) for c in points]
    return [2 / samples * sum(v * math.sin(2 * k * c) for v, c in zip(values, points)) for k in range(1, terms + 1)]


def with_lambert72(df: DataFrame, lat: str = "latitude", lon: str = "longitude", x: str = "x", y: str = "y") -> DataFrame:
    """Adds planar metres for WGS84 degrees (datum shift solved as the inverse linear map)."""
    moved = [part - F.lit(s) for part, s in zip(_ecef(F.radians(lat), F.radians(lon), WGS84_A, WGS84_F), SHIFT_M)]
    local = _linear(inverse_3x3(shift_matrix()), moved)
    df = evaluate_once(df, dict(zip(("_cx", "_cy", "_cz"), local)))
    local = [F.col(c) for c in ("_cx", "_cy", "_cz")]
    df = evaluate_once(df, {"_phi": F.atan(_tan_latitude(local, INTL_A, INTL_F)),
                            "_theta": F.lit(CONE_N) * (F.atan2(local[1], local[0]) - F.lit(CONE_LON0))})
    es = F.lit(_INTL_E) * F.sin("_phi")
    t = F.tan(F.lit(math.pi / 4) - F.col("_phi") / 2) / F.pow((1 - es) / (1 + es), F.lit(_INTL_E / 2))
    rho = F.lit(CONE_SCALE) * F.pow(t, F.lit(CONE_N))
    placed = {x: F.lit(CONE_X0) + rho * F.sin("_theta"), y: F.lit(CONE_Y0 + CONE_RHO0) - rho * F.cos("_theta")}
    return evaluate_once(df, placed).drop("_cx", "_cy", "_cz", "_phi", "_theta")


def with_wgs84(df: DataFrame, x: str = "x", y: str = "y", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Adds WGS84 degrees for planar Lambert 72 metres."""
    east, north = F.col(x) - F.lit(CONE_X0), F.lit(CONE_RHO0 + CONE_Y0) - F.col(y)
    t = F.pow(F.sqrt(east * east + north * north) / F.lit(CONE_SCALE), F.lit(1 / CONE_N))
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    df = evaluate_once(df, {"_chi": chi, "_lon": F.lit(CONE_LON0) + F.atan2(east, north) / F.lit(CONE_N)})
    series = F.col("_chi")
    for k, weight in enumerate(_latitude_series(), start=1):
        series = series + F.lit(weight) * F.sin(2 * k * F.col("_chi"))
    df = evaluate_once(df, {"_lat": series})
    turned = _linear(shift_matrix(), _ecef(F.col("_lat"), F.col("_lon"), INTL_A, INTL_F))
    moved = [part + F.lit(s) for part, s in zip(turned, SHIFT_M)]
    df = evaluate_once(df, dict(zip(("_cx", "_cy", "_cz"), moved)))
    moved = [F.col(c) for c in ("_cx", "_cy", "_cz")]
    placed = {lat: F.degrees(F.atan(_tan_latitude(moved, WGS84_A, WGS84_F))), lon: F.degrees(F.atan2(moved[1], moved[0]))}
    return evaluate_once(df, placed).drop("_chi", "_lon", "_lat", "_cx", "_cy", "_cz")


def pixel_index(x: Column, y: Column) -> tuple[Column, Column]:
    """Raster column and row of planar metres."""
    col = F.floor((x - F.lit(RASTER_X)) / F.lit(PIXEL_M)).cast("bigint")
    row = F.floor((F.lit(RASTER_Y) - y) / F.lit(PIXEL_M)).cast("bigint")
    return col, row


def in_raster(col: Column, row: Column) -> Column:
    return (col >= 0) & (col < RASTER_COLUMNS) & (row >= 0) & (row < RASTER_ROWS)


# --- European equal-area grid (EPSG:3035) -----------------------------------------------------
# GRS80 ellipsoid, projection centre and false origin.
LAEA_A, LAEA_E2 = 6378137.0, 0.00669438002290
LAEA_LAT0, LAEA_LON0 = math.radians(52.0), 10.0
LAEA_X0, LAEA_Y0 = 4321000.0, 3210000.0
_LAEA_E = math.sqrt(LAEA_E2)


def _authalic(sine: float) -> float:
    es = _LAEA_E * sine
    return (1 - LAEA_E2) * (sine / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * _LAEA_E))


LAEA_QP = _authalic(1.0)
_BETA0 = math.asin(_authalic(math.sin(LAEA_LAT0)) / LAEA_QP)
LAEA_SIN0, LAEA_COS0 = math.sin(_BETA0), math.cos(_BETA0)
_RQ = math.sqrt(0.5 * LAEA_QP)
_STRETCH = math.cos(LAEA_LAT0) / (math.sqrt(1 - LAEA_E2 * math.sin(LAEA_LAT0) ** 2) * _RQ * LAEA_COS0)
# East and north need different scales in the oblique ellipsoidal case.
LAEA_SCALE_X, LAEA_SCALE_Y = LAEA_A * _RQ * _STRETCH, LAEA_A * _RQ / _STRETCH


def with_laea(df: DataFrame, lat: str = "latitude", lon: str = "longitude", x: str = "x", y: str = "y") -> DataFrame:
    """Adds equal-area metres for WGS84 degrees; longitudes wrap to within 180 degrees of the centre."""
    es = F.lit(_LAEA_E) * F.sin(F.radians(lat))
    q = F.lit(1 - LAEA_E2) * (
        F.sin(F.radians(lat)) / (1 - es * es) - F.log((1 - es) / (1 + es)) / F.lit(2 * _LAEA_E))
    wrapped = F.pmod(F.col(lon) - F.lit(LAEA_LON0) + 180.0, F.lit(360.0)) - 180.0
    df = evaluate_once(df, {"_beta": F.asin(q / F.lit(LAEA_QP)), "_theta": F.radians(wrapped)})
    sin_b, cos_b = F.sin("_beta"), F.cos("_beta")
    depth = 1 + F.lit(LAEA_SIN0) * sin_b + F.lit(LAEA_COS0) * cos_b * F.cos("_theta")
    scale = F.when(depth > 0, F.sqrt(F.lit(2.0) / depth))
    north = F.lit(LAEA_COS0) * sin_b - F.lit(LAEA_SIN0) * cos_b * F.cos("_theta")
    placed = {x: F.lit(LAEA_X0) + F.lit(LAEA_SCALE_X) * scale * cos_b * F.sin("_theta"),
              y: F.lit(LAEA_Y0) + F.lit(LAEA_SCALE_Y) * scale * north}
    return evaluate_once(df, placed).drop("_beta", "_theta")


# --- regular grids ----------------------------------------------------------------------------
GRID_STEP_DEGREES = 0.25


def grid_snap(value: Column, step: float = GRID_STEP_DEGREES) -> Column:
    """Nearest grid step, ties to even."""
    return F.rint(value / F.lit(step)) * F.lit(step)


def grid_key(latitude: Column, longitude: Column) -> Column:
    """Text key of a snapped cell."""
    return F.concat_ws("/", grid_snap(latitude).cast("string"), grid_snap(longitude).cast("string"))


def axis_index(value: Column, first: float, step: float, size: int) -> Column:
    """0-based nearest centre of a regular axis; a tie takes the lower index."""
    raw = F.ceil((value - F.lit(first)) / F.lit(step) - 0.5)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(size - 1)).cast("bigint")


def axis_offset(value: Column, index: Column, first: float, step: float) -> Column:
    return value - (F.lit(first) + index * F.lit(step))


def within_half_step(offset: Column, step: float) -> Column:
    return F.abs(offset) <= F.lit(step / 2 + 1e-6)


def map_position(value: Column, low: Column, high: Column) -> Column:
    """Display coordinate in 1..83; a flat range sits at 50."""
    return F.when(high == low, F.lit(50.0)).otherwise(1 + (value - low) / (high - low) * 82)


def rounded_metres(distance: Column) -> Column:
    return rounded(distance, 1)
