"""Exact intervals of routes under polygon covers and their buffers: cuts, parity and closed-form capsules.

Covers come as edges of closed rings (holes are rings of the same polygon, parity decides). A segment is cut where it meets an edge, so every
interval between two cuts lies wholly inside or outside each polygon and is judged at its midpoint; what runs along an edge is covered. Within
a distance of an edge means inside a capsule, whose part of a line is one interval in closed form; there is no sampling step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.operators import linear
from terrascreen.operators.ordering import blocked_scan, materialise, ordered_blocks
from terrascreen.operators.spatial import edge_tiles, inside_polygons, outer_polygons

#: Distance under which a point lies on a line, and the longest interval that is only rounding, metres.
ON_LINE_M, SLIVER_M = 1e-9, 1e-9
TILE_M = 50.0


def _ends(alias: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{alias}.{c}") for c in ("x1", "y1", "x2", "y2"))


def _met(segments: DataFrame, edges: DataFrame, keys: list[str], margin: float, tile_m: float) -> DataFrame:
    """Pairs of segments ``s`` and edges ``e`` at most ``margin`` apart in some tile; a pair may come more than once."""
    lines = linear.dealt(segments).select(*keys, "part", F.struct("x1", "y1", "x2", "y2", "len", "offset").alias("s"), "x1", "y1", "x2", "y2")
    lines = edge_tiles(lines, tile_m, 1e-6).select(*keys, "part", "s", "tx", "ty")
    shapes = edge_tiles(edges.select("x1", "y1", "x2", "y2").distinct(), tile_m, margin + 1e-6)
    return linear.met_on_tiles(lines, shapes.select(F.struct("x1", "y1", "x2", "y2").alias("e"), "tx", "ty"))


def _clipped(low: Column, high: Column) -> tuple[Column, Column]:
    """Both ends on the segment; an end that is null stays null, so nothing that is missing turns into a whole segment."""
    return F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))), F.when(high.isNotNull(), F.least(high, F.col("s.len")))


def _placed(pairs: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """Intervals with a length, measured from the start of the route.

    The row number keeps the test where it is: pushed below the join it would hold the whole formula once more for each of its uses.
    """
    found = pairs.select(*keys, "s.offset", low.alias("a"), high.alias("b"), F.monotonically_increasing_id().alias("_row"))
    found = found.where((F.col("b") - F.col("a") > SLIVER_M) & (F.col("_row") >= 0))
    return found.select(*keys, (F.col("offset") + F.col("a")).alias("a"), (F.col("offset") + F.col("b")).alias("b"))


def polygon_overlaps(segments: DataFrame, edges: DataFrame, keys: list[str], poly_id: str = "poly_id", tile_m: float = TILE_M) -> DataFrame:
    """Intervals ``keys, a, b`` of each route inside or along the boundary of some polygon; they may touch or overlap.

    ``segments`` is a :func:`linear.route_segments` table, ``edges`` has ``poly_id, x1, y1, x2, y2``.
    """
    keys = list(keys)
    px, py, qx, qy = _ends("s")
    ax, ay, bx, by = _ends("e")
    length = F.col("s.len")
    dx, dy = (qx - px) / length, (qy - py) / length
    ex, ey = bx - ax, by - ay
    cross = dx * ey - dy * ex
    along = lambda x, y: (x - px) * dx + (y - py) * dy
    beside = lambda x, y: (x - px) * dy - (y - py) * dx
    pairs = _met(segments, edges, keys, 0.0, tile_m)
    flat = (F.abs(beside(ax, ay)) <= ON_LINE_M) & (F.abs(beside(bx, by)) <= ON_LINE_M)
    reach = F.try_divide(F.lit(ON_LINE_M), F.hypot(ex, ey))
    share = F.try_divide((ax - px) * dy - (ay - py) * dx, cross)
    hit = ~flat & (cross != 0) & share.between(-reach, 1 + reach)
    at = F.try_divide((ax - px) * ey - (ay - py) * ex, cross)
    runs_low, runs_high = _clipped(F.least(along(ax, ay), along(bx, by)), F.greatest(along(ax, ay), along(bx, by)))
    # The row number keeps the test after the formula (see _placed).
    pairs = materialise(pairs.select(*keys, "part", "s", F.monotonically_increasing_id().alias("_row"), F.when(hit, at).alias("at"), F.when(flat, runs_low).alias("low"), F.when(flat, runs_high).alias("high"))
                        .where("(at is not null or low is not null) and _row >= 0").drop("_row"), "crossings")
    spots = pairs.select(*keys, "part", "s", F.explode(F.array("at", "low", "high")).alias("at")).where(F.col("at") > 0).where(F.col("at") < F.col("s.len"))
    ends = segments.select(*keys, "part", F.struct("x1", "y1", "x2", "y2", "len", "offset").alias("s"))
    ends = ends.select(*keys, "part", "s", F.explode(F.array(F.lit(0.0), "s.len")).alias("at"))
    cuts = ordered_blocks(spots.unionByName(ends).distinct(), [*[F.col(k) for k in keys], F.col("part"), F.col("at")], "cuts")
    spans = blocked_scan(cuts, [*keys, "part"], {"from": ("previous", F.col("at"))}).where(F.col("at") - F.col("from") > SLIVER_M)
    middle = (F.col("from") + F.col("at")) / 2 / F.col("s.len")
    spans = materialise(spans.select(*keys, "part", "from", "at", F.col("s.offset").alias("offset"),
                                     (F.col("s.x1") + middle * (F.col("s.x2") - F.col("s.x1"))).alias("x"), (F.col("s.y1") + middle * (F.col("s.y2") - F.col("s.y1"))).alias("y")), "spans")
    points = spans.select("x", "y").distinct()
    covered = spans.join(inside_polygons(points.withColumns({"px": F.col("x"), "py": F.col("y")}), ["px", "py"], edges, poly_id).select(F.col("px").alias("x"), F.col("py").alias("y")), ["x", "y"])
    covered = covered.select(*keys, (F.col("offset") + F.col("from")).alias("a"), (F.col("offset") + F.col("at")).alias("b"))
    return covered.unionByName(_placed(pairs.where("low is not null"), keys, F.col("low"), F.col("high")))


def edge_overlaps(segments: DataFrame, edges: DataFrame, keys: list[str], distance_m: float, tile_m: float = TILE_M) -> DataFrame:
    """Intervals ``keys, a, b`` of each route within ``distance_m`` of an edge, in closed form; they may touch or overlap.

    The places within a distance of an edge are two disks around its ends and the band between them. They are convex together, so what they
    have of a line is one interval, from the first entry to the last exit.
    """
    keys, reach, infinite = list(keys), F.lit(float(distance_m)), F.lit(float("inf"))
    c = F.col
    px, py, qx, qy = _ends("s")
    ax, ay, bx, by = _ends("e")
    # Every stage is used several times by the next one, so plans keep them apart and no expression is repeated.
    pairs = _met(segments, edges, keys, distance_m, tile_m).select(
        *keys, "s", ((qx - px) / c("s.len")).alias("dx"), ((qy - py) / c("s.len")).alias("dy"), (ax - px).alias("ax"), (ay - py).alias("ay"), (bx - px).alias("bx"), (by - py).alias("by"),
        F.hypot(bx - ax, by - ay).alias("size"))
    pairs = pairs.withColumns({"ux": F.try_divide(c("bx") - c("ax"), c("size")), "uy": F.try_divide(c("by") - c("ay"), c("size"))})
    # Ends of the edge along and beside the line; the line along (u) and beside (v) the edge, as start and slope.
    pairs = pairs.select(
        *keys, "s", "size", (c("ax") * c("dx") + c("ay") * c("dy")).alias("am"), (c("ax") * c("dy") - c("ay") * c("dx")).alias("ao"),
        (c("bx") * c("dx") + c("by") * c("dy")).alias("bm"), (c("bx") * c("dy") - c("by") * c("dx")).alias("bo"),
        (-c("ax") * c("ux") - c("ay") * c("uy")).alias("u0"), (c("dx") * c("ux") + c("dy") * c("uy")).alias("u1"),
        (-c("ax") * c("uy") + c("ay") * c("ux")).alias("v0"), (c("dx") * c("uy") - c("dy") * c("ux")).alias("v1"))
    half = lambda off: F.when(F.abs(off) <= reach, F.sqrt(F.greatest(reach * reach - off * off, F.lit(0.0))))
    bound = lambda start, slope, at: F.try_divide(at - start, slope)
    pairs = pairs.withColumns({
        "ah": half(c("ao")), "bh": half(c("bo")), "u_a": bound(c("u0"), c("u1"), F.lit(0.0)), "u_b": bound(c("u0"), c("u1"), c("size")),
        "v_a": bound(c("v0"), c("v1"), -reach), "v_b": bound(c("v0"), c("v1"), reach), "u_in": c("u0").between(F.lit(0.0), c("size")), "v_in": c("v0").between(-reach, reach)})
    # A line that runs along an edge, or straight at it, is within a bound everywhere or nowhere.
    enter = lambda k: F.coalesce(F.least(f"{k}_a", f"{k}_b"), F.when(c(f"{k}_in"), -infinite).otherwise(infinite))
    leave = lambda k: F.coalesce(F.greatest(f"{k}_a", f"{k}_b"), F.when(c(f"{k}_in"), infinite).otherwise(-infinite))
    pairs = pairs.withColumns({"enter": F.greatest(enter("u"), enter("v")), "leave": F.least(leave("u"), leave("v"))})
    pairs = pairs.select(*keys, "s", F.least(c("am") - c("ah"), c("bm") - c("bh"), F.when(c("enter") <= c("leave"), c("enter"))).alias("low"),
                         F.greatest(c("am") + c("ah"), c("bm") + c("bh"), F.when(c("enter") <= c("leave"), c("leave"))).alias("high"))
    return _placed(pairs, keys, *_clipped(c("low"), c("high"))).distinct()


def cover_overlaps(segments: DataFrame, edges: DataFrame, keys: list[str], distance_m: float = 0.0, poly_id: str = "poly_id") -> DataFrame:
    """Merged intervals of each route inside a cover or within ``distance_m`` of it; boundaries count as covered."""
    edges = materialise(outer_polygons(edges, poly_id), "outer-edges")
    found = polygon_overlaps(segments, edges, keys, poly_id)
    if distance_m > 0:
        found = found.unionByName(edge_overlaps(segments, edges, keys, distance_m))
    return linear.interval_merge(found, list(keys))


def route_polygon_profile(segments: DataFrame, edges: DataFrame, keys: list[str] = ("gid",), distance_m: float = 0.0, poly_id: str = "poly_id") -> DataFrame:
    """Overlap, share and longest gap of every route under a polygon cover, buffered by ``distance_m``."""
    keys = list(keys)
    return linear.overlap_profile(cover_overlaps(segments, edges, keys, distance_m, poly_id), linear.route_lengths(segments, keys), keys)
