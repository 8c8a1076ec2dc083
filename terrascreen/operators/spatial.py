"""Spatial joins as equi joins on grid buckets; no nested-loop plan and no fan-out of raw rows.

Nearest-neighbour work is done once per occupied grid cell of the query points: distance to a
target changes by at most the cell radius inside a cell, so ``d(centre, target) <= best + 2 r``
keeps every target that can be nearest to any point of the cell. The points then meet a short
candidate list and stay one row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascreen.functions.geo import METRES_PER_DEGREE, haversine_m, rounded_metres
from terrascreen.operators.ordering import materialise

# Grid pyramid: each level is twice as coarse; the last level is one bucket for what lies farther
# apart than all others reach (about 1,000 km for stations, 260 km for edges).
RATIO, TOP_LEVEL = 2, 15
# Planar reasoning about bucket rings is only trusted up to this share of the bucket width.
SAFETY = 0.98


def _neighbours(x: str, y: str) -> Column:
    """The 3x3 block around a bucket, one row each."""
    shifts = f"transform(sequence(-1L, 1L), i -> transform(sequence(-1L, 1L), j -> named_struct('bx', {x} + i, 'by', {y} + j)))"
    return F.expr(f"explode(flatten({shifts}))")


def _at_level(index: str, level: str = "lv") -> str:
    """SQL of a leaf index at a coarser level of the pyramid."""
    return f"CASE WHEN {level} = {TOP_LEVEL} THEN 0L ELSE CAST(floor({index} / pow({RATIO}D, {level})) AS BIGINT) END"


def candidates_per_cell(cells: DataFrame, targets: DataFrame, payload: list[str], cell_m: float, stretch: Column,
                        distance: Callable[[Column, Column], Column], crossed: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Targets that can be nearest to some point of each cell: rows ``cx, cy`` and payload.

    A target that covers several buckets may be repeated.

    ``cells`` has ``cx, cy`` (leaf indices) and ``px, py`` (centre coordinates); ``targets`` has
    the index range ``tx0..tx1, ty0..ty1`` it covers at leaf level plus ``payload`` columns.
    ``stretch`` bounds how much wider than ``cell_m`` a cell may be from east to west. ``crossed``
    narrows the bucket rows of a target in one bucket column (column and width in, first and last
    row out); without it a target lies on its whole index range.
    """
    levels = F.sequence(F.lit(0), F.lit(TOP_LEVEL))
    radius = F.lit(cell_m / 2) * F.sqrt(1 + stretch * stretch)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumns({"bx": F.expr(_at_level("cx")), "by": F.expr(_at_level("cy"))})

    def covering(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.expr(f"explode(sequence({_at_level(a)}, {_at_level(b)}))")
        columns = df.withColumn("gx", span("tx0", "tx1"))
        if crossed is None:
            return columns.withColumn("gy", span("ty0", "ty1"))
        low, high = crossed(F.col("gx"), F.lit(float(cell_m)) * F.pow(F.lit(float(RATIO)), F.col("lv")))
        top = F.col("lv") == TOP_LEVEL
        return columns.withColumn("gy", F.explode(F.sequence(F.when(top, 0).otherwise(low), F.when(top, 0).otherwise(high))))

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("_b", _neighbours("bx", "by")).withColumns({"bx": F.col("_b.bx"), "by": F.col("_b.by")}).drop("_b")

    def offered(used: DataFrame) -> DataFrame:
        # Only the levels some cell searches are laid out; there are at most TOP_LEVEL + 1 of them.
        wanted = F.broadcast(used.select("lv").distinct())
        laid = covering(targets.withColumn("lv", F.explode(levels)).join(wanted, "lv", "left_semi"))
        return laid.select(*payload, "lv", F.col("gx").alias("bx"), F.col("gy").alias("by"))

    extents = (targets.select("tx0", "tx1", "ty0", "ty1").distinct() if crossed is None else targets).withColumn("lv", F.explode(levels))
    occupied = around(covering(extents).select("lv", F.col("gx").alias("bx"), F.col("gy").alias("by")).distinct()).distinct()
    probe = bucketed(cells.withColumn("lv", F.explode(levels)))
    found = (probe.join(occupied, ["lv", "bx", "by"], "left_semi")
             .groupBy("cx", "cy", "px", "py").agg(F.min("lv").alias("lv")))
    found = materialise(bucketed(found), "cells")
    # Any target of that ring bounds the best distance from above.
    bound = (around(found).join(offered(found), ["lv", "bx", "by"]).groupBy("cx", "cy", "px", "py")
             .agg((F.min(distance(F.col("px"), F.col("py"))) + 2 * radius + 1e-6).alias("limit")))
    # The search level is the first whose ring surely holds everything within the limit.
    wanted = F.greatest(F.ceil(F.log(F.col("limit") / F.lit(SAFETY * cell_m)) / F.lit(math.log(RATIO))), F.lit(0))
    level = F.when(wanted >= TOP_LEVEL, F.lit(TOP_LEVEL)).otherwise(wanted).cast("int")
    search = materialise(bucketed(bound.withColumn("lv", level)), "search")
    pairs = around(search).join(offered(search), ["lv", "bx", "by"]).where(distance(F.col("px"), F.col("py")) <= F.col("limit"))
    return pairs.select("cx", "cy", *payload)


def _lat_span(*tables: DataFrame) -> Column:
    """Largest absolute latitude of the inputs as a scalar."""
    parts = [t.select(F.abs("latitude").alias("a")) for t in tables]
    merged = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return merged.agg(F.coalesce(F.max("a"), F.lit(0.0)).alias("a")).scalar()


def nearest_station(sites: DataFrame, stations: DataFrame, cell_m: float = 31.25) -> DataFrame:
    """Adds ``nearest_station`` and ``distance_m`` (1 dp); ties go to the lowest ``ord``.

    Stations at one location collapse to the first of them, sites at one location are searched
    once. Candidates meet locations as pairs whose minimum is taken inside each task, so no cell
    holds a list, however crowded it is. Sites without coordinates keep a null result.
    """
    points = (stations.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
              .groupBy("latitude", "longitude").agg(F.min_by("id", "ord").alias("sid"), F.min("ord").alias("sord"))
              .select("sid", "sord", F.col("latitude").alias("slat"), F.col("longitude").alias("slon")))
    lat_max = _lat_span(sites, stations)
    located = sites.withColumn("_cos", F.cos(F.radians(lat_max)))
    step_lat = cell_m / METRES_PER_DEGREE
    lon_index = lambda lon: F.floor(lon * F.col("_cos") / F.lit(step_lat)).cast("bigint")
    located = located.withColumns({"cx": lon_index(F.col("longitude")), "cy": F.floor(F.col("latitude") / F.lit(step_lat)).cast("bigint")})
    cells = (located.where(F.col("cx").isNotNull() & F.col("cy").isNotNull()).select("cx", "cy", "_cos").distinct()
             .select("cx", "cy", ((F.col("cx") + 0.5) * F.lit(step_lat) / F.col("_cos")).alias("px"), ((F.col("cy") + 0.5) * F.lit(step_lat)).alias("py")))
    # A second copy on the other side of the 180th meridian; distances are the same for both.
    other = F.when(F.col("slon") < 0, F.col("slon") + 360).otherwise(F.col("slon") - 360)
    points = points.unionByName(points.withColumn("slon", other)).withColumn("_cos", F.cos(F.radians(lat_max)))
    targets = points.withColumns({"tx0": lon_index(F.col("slon")), "ty0": F.floor(F.col("slat") / F.lit(step_lat)).cast("bigint")})
    targets = targets.withColumns({"tx1": F.col("tx0"), "ty1": F.col("ty0")})
    stretch = F.lit(1.0) / F.cos(F.radians(lat_max))
    near = candidates_per_cell(cells, targets, ["sid", "sord", "slat", "slon"], cell_m, stretch,
                               lambda px, py: haversine_m(py, px, F.col("slat"), F.col("slon")))
    places = located.select("cx", "cy", "latitude", "longitude").distinct()
    found = F.min(F.struct(haversine_m(F.col("latitude"), F.col("longitude"), F.col("slat"), F.col("slon")).alias("d"), F.col("sord").alias("o"), F.col("sid").alias("s")))
    best = places.join(near, ["cx", "cy"]).groupBy("latitude", "longitude").agg(found.alias("_best"))
    joined = sites.join(best, ["latitude", "longitude"], "left")
    return joined.select(*[sites[c] for c in sites.columns], F.col("_best.s").alias("nearest_station"), rounded_metres(F.col("_best.d")).alias("distance_m"))


def pairs_within(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of rows at most ``radius_m`` apart: equi join on buckets at least that wide.

    Inputs carry ``l_lat, l_lon`` and ``r_lat, r_lon``; the right side is replicated 3x3, so give
    the smaller side there. Callers collapse rows that share a location first.
    """
    spans = left.select(F.abs("l_lat").alias("latitude")), right.select(F.abs("r_lat").alias("latitude"))
    lat_max = _lat_span(*spans)
    width = radius_m * 1.001 / METRES_PER_DEGREE

    def indexed(df: DataFrame, lat: str, lon: str) -> DataFrame:
        df = df.withColumn("_cos", F.cos(F.radians(lat_max)))
        return df.withColumns({"bx": F.floor(F.col(lon) * F.col("_cos") / F.lit(width)).cast("bigint"),
                               "by": F.floor(F.col(lat) / F.lit(width)).cast("bigint")}).drop("_cos")

    # What lies within a radius of the 180th meridian is offered on its other side as well.
    margin = F.lit(2 * width) / F.col("_cos")
    edge = right.withColumn("_cos", F.cos(F.radians(lat_max))).where(180 - F.abs("r_lon") <= margin).drop("_cos")
    across = edge.withColumn("r_lon", F.when(F.col("r_lon") < 0, F.col("r_lon") + 360).otherwise(F.col("r_lon") - 360))
    near = indexed(right.unionByName(across), "r_lat", "r_lon")
    near = near.withColumn("_b", _neighbours("bx", "by")).withColumns({"bx": F.col("_b.bx"), "by": F.col("_b.by")}).drop("_b")
    pairs = indexed(left, "l_lat", "l_lon").join(near, ["bx", "by"])
    pairs = pairs.withColumn("d", haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    return pairs.where(F.col("d") <= radius_m).drop("bx", "by")


def radius_counts(incidents: DataFrame, stations: DataFrame, inner_m: float = 250.0, outer_m: float = 500.0) -> DataFrame:
    """Incidents, all and flagged, within two inclusive radii of every station; zero rows kept.

    Incidents collapse to one weighted row per location before the join.
    """
    spots = (incidents.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
             .groupBy(F.col("latitude").alias("l_lat"), F.col("longitude").alias("l_lon"))
             .agg(F.count("*").alias("n"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("nf")))
    right = stations.select("id", F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"))
    pairs = pairs_within(spots, right, outer_m)
    inner = F.col("d") <= inner_m
    counts = pairs.groupBy("id").agg(
        F.sum(F.when(inner, F.col("n"))).alias("within_inner"), F.sum(F.when(inner, F.col("nf"))).alias("flagged_inner"),
        F.sum("n").alias("within_outer"), F.sum("nf").alias("flagged_outer"))
    names = ["within_inner", "flagged_inner", "within_outer", "flagged_outer"]
    joined = stations.join(counts, "id", "left")
    return joined.select(*stations.columns, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def crosswalk_match(legacy: DataFrame, live: DataFrame, radius_m: float = 2.0) -> DataFrame:
    """Legacy id to live id, one to one by position, with the reason where that fails.

    Both sides collapse to locations, so a pile of rows at one spot costs one pair.
    """
    spots = legacy.groupBy(F.col("latitude").alias("l_lat"), F.col("longitude").alias("l_lon")).agg(F.count("*").alias("_n")).drop("_n")
    targets = live.groupBy(F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon")).agg(F.count("*").alias("n"), F.min("id").alias("live_id"))
    matched = pairs_within(spots, targets, radius_m).groupBy("l_lat", "l_lon").agg(F.sum("n").alias("matches"), F.min("live_id").alias("live_id"))
    rows = legacy.select(F.col("id").alias("legacy_id"), F.col("latitude").alias("l_lat"), F.col("longitude").alias("l_lon"))
    rows = rows.join(matched, ["l_lat", "l_lon"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("live_id", F.when(F.col("matches") == 1, F.col("live_id")))
    users = rows.where(F.col("live_id").isNotNull()).groupBy("live_id").agg(F.count("*").alias("users"))
    status = (F.when(F.col("matches") == 0, "none").when(F.col("matches") > 1, "ambiguous")
              .when(F.col("users") > 1, "shared").otherwise("matched"))
    return rows.join(users, "live_id", "left").select("legacy_id", "live_id", "matches", status.alias("status"))


# --- planar covers ----------------------------------------------------------------------------

def _segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / length2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def box_edges(boxes: DataFrame, box_id: str = "poly_id") -> DataFrame:
    """The four edges of axis-parallel boxes as an edge table."""
    c = F.col
    corners = [("x1", "y1", "x2", "y1"), ("x2", "y1", "x2", "y2"), ("x2", "y2", "x1", "y2"), ("x1", "y2", "x1", "y1")]
    edges = F.array(*[F.struct(c(a).alias("x1"), c(b).alias("y1"), c(d).alias("x2"), c(e).alias("y2")) for a, b, d, e in corners])
    return boxes.select(box_id, F.explode(edges).alias("e")).select(box_id, "e.x1", "e.y1", "e.x2", "e.y2")


#: Rows of a tile that are compared at once, the largest boxes of a tile that others are held against, and boxes of a tile for one task.
CHUNK, HOLDERS, CROWD = 512, 1024, 20_000
SIDES = ["x1", "y1", "x2", "y2"]


def outer_boxes(boxes: DataFrame, box_id: str | None = None, tile_m: float = 50.0) -> DataFrame:
    """Sides (and ``box_id``) of boxes with the same union: equal ones once, without those that were found inside another one.

    A box is held against the largest ones of the tile of its lower left corner, which any box around it reaches; crowded tiles are dealt over
    several tasks, so a box inside another may stay, but none that the union needs goes. With ``box_id``, only boxes take part whose id is theirs
    alone: polygons of several boxes, and boxes without an id or with sides in reverse, stay as they are.
    """
    names = [*([box_id] if box_id else []), *SIDES]
    plain = F.coalesce((F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")), F.lit(False))
    boxes = boxes.select(*names)
    if box_id:
        several = boxes.groupBy(box_id).agg(F.count("*").alias("n")).where("n > 1").select(box_id)
        plain = plain & F.col(box_id).isNotNull()
        single = boxes.where(plain).join(several, box_id, "left_anti")
        others = boxes.where(~plain).unionByName(boxes.where(plain).join(several, box_id, "left_semi").select(*names))
    else:
        single, others = boxes.where(plain), boxes.where(~plain).distinct()
    classes = single.groupBy(*SIDES).agg(F.min(box_id).alias(box_id)) if box_id else single.distinct()
    tile = lambda v: F.floor(F.col(v) / F.lit(tile_m)).cast("bigint")
    tiled = classes.withColumn("tx", F.explode(F.sequence(tile("x1"), tile("x2")))).withColumn("ty", F.explode(F.sequence(tile("y1"), tile("y2"))))
    crowds = tiled.groupBy("tx", "ty").agg(F.ceil(F.count("*") / CROWD).alias("tasks"))
    dealt = tiled.join(crowds, ["tx", "ty"]).withColumns({
        "salt": F.pmod(F.xxhash64(*SIDES), F.col("tasks")), "own": (F.col("tx") == tile("x1")) & (F.col("ty") == tile("y1")),
        "size": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))})
    group = ["tx", "ty", "salt"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, F.desc("size"), *SIDES).select(*names, *group, "own")
    around = lambda a, b: (a[None, :, 0] <= b[:, None, 0]) & (a[None, :, 1] <= b[:, None, 1]) & (a[None, :, 2] >= b[:, None, 2]) & (a[None, :, 3] >= b[:, None, 3])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, holders = None, np.empty((0, 4))
        for batch in batches:
            sides = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in SIDES])
            tiles = np.column_stack([batch.column(c).to_numpy() for c in group])
            stays = np.zeros(len(sides), bool)
            starts = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]).any(axis=1)])
            for start, end in zip(starts, np.r_[starts[1:], len(tiles)]):
                if (now := tuple(tiles[start])) != last:
                    last, holders = now, np.empty((0, 4))
                for at in range(start, end, CHUNK):
                    rows = np.arange(at, min(at + CHUNK, end))
                    rows = rows[~around(holders, sides[rows]).any(axis=1)]
                    rows = rows[~np.tril(around(sides[rows], sides[rows]), -1).any(axis=1)]
                    stays[rows] = True
                    holders = np.concatenate([holders, sides[rows]])[:HOLDERS]
            yield batch.filter(pa.array(stays & batch.column("own").to_numpy(zero_copy_only=False))).select(names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*names).schema)
    return dealt.mapInArrow(keep, schema).unionByName(others)


#: Corners of polygons that :func:`outer_polygons` looks at; polygons of more stay as they are.
MOST_CORNERS = 16


def outer_polygons(edges: DataFrame, poly_id: str = "poly_id", tile_m: float = 50.0) -> DataFrame:
    """The edges without those of convex polygons that were found inside another convex one: the same union, and the same distances to it.

    As in :func:`outer_boxes`, a polygon is held against the largest ones of the tile of its lower left corner, so one inside another may stay,
    but none that the union needs goes. Polygons without an id, of several rings, with corners that turn both ways or of many corners stay.
    """
    c = F.col
    names = [poly_id, *SIDES]
    side = F.struct(*SIDES)
    rings = edges.where(c(poly_id).isNotNull()).groupBy(poly_id).agg(F.count("*").alias("n"), F.min("x1").alias("low_x"), F.min("y1").alias("low_y"), F.max("x1").alias("high_x"), F.max("y1").alias("high_y"))
    rings = rings.where(c("n").between(3, MOST_CORNERS))
    lists = edges.join(rings.hint("merge"), poly_id).groupBy(poly_id, "low_x", "low_y", "high_x", "high_y").agg(F.sort_array(F.collect_list(side)).alias("ring"))
    # Equal shapes count once.
    classes = lists.groupBy("ring", "low_x", "low_y", "high_x", "high_y").agg(F.min(poly_id).alias(poly_id), F.count("*").alias("times"))
    index = lambda name: F.floor(c(name) / F.lit(tile_m)).cast("bigint")
    tiled = classes.withColumn("tx", F.explode(F.sequence(index("low_x"), index("high_x")))).withColumn("ty", F.explode(F.sequence(index("low_y"), index("high_y"))))
    crowds = tiled.groupBy("tx", "ty").agg(F.ceil(F.count("*") / CROWD).alias("tasks"))
    dealt = tiled.join(crowds, ["tx", "ty"]).withColumns({
        "salt": F.pmod(F.xxhash64("ring"), c("tasks")), "own": (c("tx") == index("low_x")) & (c("ty") == index("low_y")),
        "size": (c("high_x") - c("low_x")) * (c("high_y") - c("low_y"))})
    group = ["tx", "ty", "salt"]
    flat = F.transform("ring", lambda e: F.array(*[e[n].cast("double") for n in SIDES]))
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, F.desc("size"), poly_id).select(poly_id, F.flatten(flat).alias("ring"), *group, "own")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chained(ring: np.ndarray) -> np.ndarray | None:
            """Corners in order, to the left of every edge, or none where the edges are no convex ring."""
            after = {tuple(e[:2]): e for e in ring.tolist()}
            walk, at = [], tuple(ring[0, :2].tolist())
            while at in after and len(walk) <= len(ring):
                edge = after.pop(at)
                walk.append(edge[:2])
                at = tuple(edge[2:])
            if len(walk) != len(ring) or at != tuple(walk[0]):
                return None
            corners = np.array(walk)
            along = np.roll(corners, -1, 0) - corners
            turns = along[:, 0] * np.roll(along, -1, 0)[:, 1] - along[:, 1] * np.roll(along, -1, 0)[:, 0]
            whole = np.abs(np.arctan2(turns, (along * np.roll(along, -1, 0)).sum(1)).sum())
            if not np.isfinite(turns).all() or abs(whole - 2 * np.pi) > 1e-6:
                return None
            return corners if (turns > 0).all() else corners[::-1] if (turns < 0).all() else None

        def inside(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
            """Whether all corners of each of ``inner`` are in some of ``outer``; both padded to one number of corners by repeats."""
            along = np.roll(outer, -1, 1) - outer
            left = np.ones((len(inner), len(outer)), bool)
            for k in range(outer.shape[1]):
                for j in range(inner.shape[1]):
                    gap = inner[:, None, j] - outer[None, :, k]
                    left &= along[None, :, k, 0] * gap[..., 1] - along[None, :, k, 1] * gap[..., 0] >= 0
            return left

        last, holders = None, np.empty((0, MOST_CORNERS, 2))
        for batch in batches:
            rings = [chained(np.array(r.as_py(), float).reshape(-1, 4)) for r in batch.column("ring")]
            tiles = np.column_stack([batch.column(g).to_numpy() for g in group])
            stays = np.ones(len(rings), bool)
            convex = np.array([r is not None for r in rings])
            width = max([holders.shape[1] if len(holders) else 0, *[len(r) for r in rings if r is not None]], default=0)
            pad = lambda r, width: np.concatenate([r, np.repeat(r[-1:], width - len(r), 0)])
            corners = np.array([pad(r, width) if r is not None else np.zeros((width, 2)) for r in rings])
            if len(holders) and holders.shape[1] < width:
                holders = np.array([pad(h, width) for h in holders])
            starts = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]).any(axis=1)])
            for start, end in zip(starts, np.r_[starts[1:], len(tiles)]):
                if (now := tuple(tiles[start])) != last:
                    last, holders = now, np.empty((0, width, 2))
                for first in range(start, end, CHUNK):
                    rows = np.arange(first, min(first + CHUNK, end))
                    rows = rows[convex[rows]]
                    if len(holders):
                        held = inside(corners[rows], holders).any(axis=1)
                        stays[rows[held]] = False
                        rows = rows[~held]
                    each = np.tril(inside(corners[rows], corners[rows]), -1).any(axis=1)
                    stays[rows[each]] = False
                    holders = np.concatenate([holders, corners[rows[~each]]])[:HOLDERS] if len(rows) else holders
            gone = ~stays & batch.column("own").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(poly_id).filter(pa.array(gone))], [poly_id])

    id_type = edges.schema[poly_id].dataType.simpleString()
    left_out = materialise(dealt.mapInArrow(keep, f"`{poly_id}` {id_type}"), "inner-polygons")
    kept = materialise(classes.join(left_out.hint("merge"), poly_id, "left_anti").select("ring", poly_id), "outer-polygons")
    own = kept.select(poly_id, F.explode("ring").alias("e")).select(poly_id, *[c(f"e.{n}").alias(n) for n in SIDES])
    others = edges.select(*names).join(rings.select(poly_id).hint("merge"), poly_id, "left_anti")
    return own.select(*names).unionByName(others)


def distance_to_edges(points: DataFrame, point_key: list[str], edges: DataFrame, cell_m: float = 8.0) -> DataFrame:
    """Adds ``edge_distance``: exact distance from each point to the nearest edge.

    The minimum is taken per key inside every task before rows move.
    """
    index = lambda v: F.floor(v / F.lit(cell_m)).cast("bigint")
    located = points.select(*point_key, "x", "y", index(F.col("x")).alias("cx"), index(F.col("y")).alias("cy"))
    cells = located.select("cx", "cy").distinct().withColumns({"px": (F.col("cx") + 0.5) * cell_m, "py": (F.col("cy") + 0.5) * cell_m})
    unique = edges.select(*[F.col(n).alias(f"e{n}") for n in ("x1", "y1", "x2", "y2")]).distinct()
    e = [F.col(n) for n in ("ex1", "ey1", "ex2", "ey2")]
    targets = unique.withColumns({
        "tx0": index(F.least(e[0], e[2])), "tx1": index(F.greatest(e[0], e[2])),
        "ty0": index(F.least(e[1], e[3])), "ty1": index(F.greatest(e[1], e[3]))})

    def crossed(column: Column, width: Column) -> tuple[Column, Column]:
        """Bucket rows that an edge crosses inside one bucket column, with a hair's breadth to spare."""
        left, right = F.least(e[0], e[2]), F.greatest(e[0], e[2])
        at = lambda x: F.when(e[0] == e[2], None).otherwise(e[1] + (x - e[0]) / (e[2] - e[0]) * (e[3] - e[1]))
        a, b = at(F.greatest(column * width, left)), at(F.least((column + 1) * width, right))
        low, high = F.coalesce(F.least(a, b), F.least(e[1], e[3])), F.coalesce(F.greatest(a, b), F.greatest(e[1], e[3]))
        low, high = F.greatest(low - 1e-6, F.least(e[1], e[3])), F.least(high + 1e-6, F.greatest(e[1], e[3]))
        return F.floor(F.least(low, high) / width).cast("bigint"), F.floor(F.greatest(low, high) / width).cast("bigint")

    near = candidates_per_cell(cells, targets, ["ex1", "ey1", "ex2", "ey2"], cell_m, F.lit(1.0),
                               lambda px, py: _segment_distance(px, py, *e), crossed)
    best = located.join(near, ["cx", "cy"]).groupBy(*point_key).agg(F.min(_segment_distance(F.col("x"), F.col("y"), *e)).alias("edge_distance"))
    return points.join(best, point_key, "left")


#: Where the tile lines lie. They are no round numbers, so that corners of polygons do not lie on them.
ORIGIN_X, ORIGIN_Y = 0.0618033988749895, 0.0414213562373095


def _tile(value: Column, tile_m: float, origin: float) -> Column:
    return F.floor((value - origin) / F.lit(float(tile_m))).cast("bigint")


def _line(index: Column, tile_m: float, origin: float) -> Column:
    return index * F.lit(float(tile_m)) + origin


def edge_tiles(edges: DataFrame, tile_m: float, margin: float = 1e-6) -> DataFrame:
    """Each edge with all tiles ``tx, ty`` that it, or what lies within ``margin`` of it, reaches: a row per tile along the edge."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    columns = edges.withColumn("tx", F.explode(F.sequence(_tile(left - margin, tile_m, ORIGIN_X), _tile(right + margin, tile_m, ORIGIN_X))))
    at = lambda x: y1 + F.try_divide(x - x1, x2 - x1) * (y2 - y1)
    start = _line(F.col("tx"), tile_m, ORIGIN_X)
    a, b = at(F.greatest(start - margin, left)), at(F.least(start + tile_m + margin, right))
    bottom, top = F.least(y1, y2), F.greatest(y1, y2)
    low = F.greatest(F.coalesce(F.least(a, b), bottom), bottom) - margin
    high = F.least(F.coalesce(F.greatest(a, b), top), top) + margin
    return columns.withColumn("ty", F.explode(F.sequence(_tile(F.least(low, high), tile_m, ORIGIN_Y), _tile(F.greatest(low, high), tile_m, ORIGIN_Y))))


def _inside_corners(tiles: DataFrame, edges: DataFrame, poly_id: str, tile_m: float) -> DataFrame:
    """``tx, ty`` and each polygon that holds the lower left corner of that tile.

    The line through the lower corners of a row of tiles enters and leaves a polygon where its edges cross; the corners in between are a range,
    laid out as aligned ranges of 1, 2, 4, ... tiles, of which a range has at most two a level. So the rows of a wide polygon grow with the
    logarithm of its width; only rows that hold one of ``tiles`` are laid out.
    """
    rows = tiles.select("ty").distinct()
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    spans = edges.withColumn("ty", F.explode(F.sequence(_tile(bottom, tile_m, ORIGIN_Y), _tile(top, tile_m, ORIGIN_Y) + 1))).join(rows, "ty", "left_semi")
    y = _line(F.col("ty"), tile_m, ORIGIN_Y)
    crossed = spans.where((F.col("y1") > y) != (F.col("y2") > y)).select(
        poly_id, "ty", (F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("x"))
    along = Window.partitionBy(poly_id, "ty").orderBy("x")
    paired = crossed.withColumns({"nr": F.row_number().over(along), "end": F.lead("x").over(along)}).where("nr % 2 = 1")
    after = lambda x: F.ceil((x - ORIGIN_X) / F.lit(float(tile_m))).cast("bigint")
    ranges = paired.select(poly_id, "ty", after(F.col("x")).alias("first"), after(F.col("end")).alias("last")).where("last > first")
    # Aligned ranges at level lv that lie inside first..last-1 while the one above them does not.
    ranges = ranges.withColumn("lv", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("last") - F.col("first"))).cast("int"))))
    up = lambda level: f"shiftright(first + shiftleft(1L, {level}) - 1, {level})"
    ranges = ranges.selectExpr(f"`{poly_id}`", "ty", "lv", f"{up('lv')} as a", "shiftright(last, lv) as b", f"{up('lv + 1')} as pa", "shiftright(last, lv + 1) as pb")
    whole = F.expr("if(a < b, sequence(a, b - 1), array())")
    outer = F.expr("filter(array(if(a < 2 * pa, a, null), if(b > 2 * pb, b - 1, null)), v -> v is not null)")
    nodes = ranges.withColumn("node", F.explode(F.when(F.col("pa") < F.col("pb"), outer).otherwise(whole))).select(poly_id, "ty", "lv", "node")
    nodes = materialise(nodes, "corners")
    levels = [r["lv"] for r in nodes.select("lv").distinct().collect()]
    if not levels:
        return nodes.select(F.col("node").alias("tx"), "ty", poly_id)
    probe = tiles.withColumn("lv", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("node", F.expr("shiftright(tx, lv)"))
    return probe.join(nodes, ["ty", "lv", "node"]).select("tx", "ty", poly_id)


def _tile_width(points: DataFrame, edges: DataFrame, tile_m: float) -> float:
    """``tile_m`` halved as often as it makes the rows of edges and the pairs of edges with points fewer together.

    Halving quarters the points of a tile, while an edge comes to at most twice as many tiles; pairs are counted per tile, so piles count as such.
    """
    at = lambda x, y: (_tile(x, tile_m, ORIGIN_X).alias("tx"), _tile(y, tile_m, ORIGIN_Y).alias("ty"))
    spots = points.groupBy(*at(F.col("x"), F.col("y"))).agg(F.count("*").alias("p"))
    middle = edges.select(*at((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("len"))
    lines = middle.groupBy("tx", "ty").agg(F.count("*").alias("e"), F.sum("len").alias("len"))
    pairs, count, length = lines.join(spots, ["tx", "ty"], "left").agg(F.sum(F.col("e") * F.coalesce("p", F.lit(0))), F.sum("e"), F.sum("len")).first()
    if not pairs:
        return tile_m
    rows = [count + 1.5 * length * 2 ** k / tile_m for k in range(MOST_HALVINGS + 1)]
    return tile_m / 2 ** min(range(MOST_HALVINGS + 1), key=lambda k: 4 * rows[k] + pairs * rows[k] / rows[0] / 4 ** k)


#: How often a tile may be halved.
MOST_HALVINGS = 6


def inside_polygons(points: DataFrame, point_key: list[str], edges: DataFrame, poly_id: str = "poly_id", tile_m: float = 50.0) -> DataFrame:
    """Distinct keys of points inside any polygon (parity; a point on an edge may count either way, callers decide it by distance).

    A polygon holds the corner of a tile or not; from the corner to a point inside the tile, up and then along, only edges of that tile can be
    crossed. Tiles that a polygon covers without an edge of it are settled whole. Where tiles of ``tile_m`` are crowded, finer ones are taken.
    """
    tile_m = _tile_width(points, edges, tile_m)
    located = points.select(*point_key, "x", "y", _tile(F.col("x"), tile_m, ORIGIN_X).alias("tx"), _tile(F.col("y"), tile_m, ORIGIN_Y).alias("ty"))
    tiles = materialise(located.select("tx", "ty").where("tx is not null and ty is not null").distinct(), "point-tiles")
    corners = materialise(_inside_corners(tiles, edges, poly_id, tile_m).withColumn("held", F.lit(1)), "held-corners")
    local = materialise(edge_tiles(edges.select(poly_id, "x1", "y1", "x2", "y2"), tile_m).join(tiles, ["tx", "ty"], "left_semi"), "edge-tiles")
    full = corners.join(local, ["tx", "ty", poly_id], "left_anti").select("tx", "ty").distinct()
    settled = located.join(full, ["tx", "ty"], "left_semi").select(*point_key)
    near = local.join(corners, ["tx", "ty", poly_id], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    open_points = located.join(full, ["tx", "ty"], "left_anti")
    pairs = open_points.join(near, ["tx", "ty"])
    x0, y0 = _line(F.col("tx"), tile_m, ORIGIN_X), _line(F.col("ty"), tile_m, ORIGIN_Y)
    x1, y1, x2, y2, x, y = (F.col(c) for c in ("x1", "y1", "x2", "y2", "x", "y"))
    at_y, at_x = y1 + F.try_divide(x0 - x1, x2 - x1) * (y2 - y1), x1 + F.try_divide(y - y1, y2 - y1) * (x2 - x1)
    up = ((x1 > x0) != (x2 > x0)) & (at_y > y0) & (at_y <= y)
    across = ((y1 > y) != (y2 > y)) & (at_x > x0) & (at_x <= x)
    passed = up.cast("int") + across.cast("int")
    counted = pairs.select(*point_key, poly_id, "held", passed.alias("passed")).where("held = 1 or passed > 0")
    odd = counted.groupBy(*point_key, poly_id).agg((F.sum("passed") + F.max("held")).alias("n")).where(F.col("n") % 2 == 1)
    return settled.unionByName(odd.select(*point_key)).distinct()


def point_in_cover(points: DataFrame, point_key: list[str], edges: DataFrame, poly_id: str = "poly_id", near_m: float = 5.0) -> DataFrame:
    """Adds ``distance_to_cover`` (0 inside or on the boundary) and ``stratum``; edges are only searched for points that are not inside."""
    inside = inside_polygons(points, point_key, edges, poly_id).withColumn("_in", F.lit(True))
    marked = materialise(points.join(inside, point_key, "left").select(*points.columns, "_in"), "marked-points")
    away = distance_to_edges(marked.where("_in is null").drop("_in"), point_key, edges)
    placed = (away.select(*points.columns, F.col("edge_distance").alias("distance_to_cover"))
              .unionByName(marked.where("_in").select(*points.columns, F.lit(0.0).alias("distance_to_cover"))))
    distance = F.col("distance_to_cover")
    stratum = F.when(distance == 0, "mapped_overlap").when(distance <= near_m, "proximity_only").otherwise("mapped_non_overlap")
    return placed.select(*points.columns, distance, stratum.alias("stratum"))
