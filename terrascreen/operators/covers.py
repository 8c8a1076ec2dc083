"""Route metrics against covers: scenarios, windows, strata and frame reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.operators import cuts, linear, spatial
from terrascreen.operators.ordering import exact_quantiles, materialise

# The translations tried, metres east and north.
SHIFTS = [
    ("original", 0.0, 0.0),
    ("east_2m", 2.0, 0.0),
    ("west_2m", -2.0, 0.0),
    ("north_2m", 0.0, 2.0),
    ("south_2m", 0.0, -2.0),
    ("east_5m", 5.0, 0.0),
    ("west_5m", -5.0, 0.0),
    ("north_5m", 0.0, 5.0),
    ("south_5m", 0.0, -5.0),
]
BUFFERS_M = (0.0, 2.0, 5.0)
PROXIMITY_M = 5.0


def route_cover_profile(segments: DataFrame, boxes: DataFrame, keys: list[str] = ("gid",)) -> DataFrame:
    """Overlap, share and longest gap of every route under a box cover."""
    keys = list(keys)
    return linear.overlap_profile(covered_intervals(segments, boxes, keys), linear.route_lengths(segments, keys), keys)


def covered_intervals(segments: DataFrame, boxes: DataFrame, keys: list[str] = ("gid",)) -> DataFrame:
    """Merged intervals ``keys, a, b`` of every route under a box cover; boxes inside others are left out before routes meet them."""
    keys = list(keys)
    return linear.interval_merge(linear.box_overlaps(segments, spatial.outer_boxes(boxes), keys), keys)


def shift_scenarios(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """The profile of every route under each fixed translation of the whole line."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in SHIFTS])
    moved = segments.withColumn("s", F.explode(table)).select(
        "gid", F.col("s.scenario").alias("scenario"), (F.col("x1") + F.col("s.dx")).alias("x1"), (F.col("y1") + F.col("s.dy")).alias("y1"),
        (F.col("x2") + F.col("s.dx")).alias("x2"), (F.col("y2") + F.col("s.dy")).alias("y2"), "len", "offset", "route_m")
    return route_cover_profile(moved, boxes, ["gid", "scenario"])


def shift_ranges(profiles: DataFrame) -> DataFrame:
    """Per route and shift magnitude: smallest and largest overlap share; the original is left out."""
    magnitude = F.regexp_extract("scenario", r"_(\d+)m$", 1)
    return (profiles.where(F.col("scenario") != "original").groupBy("gid", magnitude.cast("bigint").alias("magnitude_m"))
            .agg(F.min("overlap_percent").alias("lowest"), F.max("overlap_percent").alias("highest")))


def buffer_scenarios(points: DataFrame, distances: dict[str, Column], step: float) -> DataFrame:
    """Route metrics per vegetation group and buffer from densified points.

    ``distances`` maps a vegetation group to the exact distance column of its cover.
    """
    groups = F.array(*[F.struct(F.lit(name).alias("vegetation"), d.alias("d")) for name, d in distances.items()])
    buffers = F.array(*[F.lit(b) for b in BUFFERS_M])
    rows = points.withColumn("g", F.explode(groups)).withColumn("buffer_m", F.explode(buffers)).select(
        "gid", "idx", "g.vegetation", "buffer_m", F.coalesce(F.col("g.d") <= F.col("buffer_m"), F.lit(False)).alias("hit"))
    keys = ["gid", "vegetation", "buffer_m"]
    spans = linear.runs(rows, keys, "idx", F.col("hit"))
    return spans.groupBy(*keys).agg(
        (F.sum("n") * step).alias("length_m"), (F.coalesce(F.sum(F.when(F.col("value"), F.col("n"))), F.lit(0)) * step).alias("overlap_m"),
        (F.coalesce(F.max(F.when(~F.col("value"), F.col("n"))), F.lit(0)) * step).alias("longest_gap_m"))


def buffered_spans(segments: DataFrame, covers: dict[str, DataFrame], keys: list[str] = ("gid",)) -> DataFrame:
    """Exact merged intervals ``a, b`` of every route per vegetation group and buffer: no points, so no step.

    ``covers`` maps a vegetation group to the edges of its polygons (``poly_id, x1, y1, x2, y2``). The intervals inside a cover are found once
    and serve all of its buffers.
    """
    keys, found = list(keys), None
    for name, edges in covers.items():
        edges = materialise(spatial.outer_polygons(edges), "outer-edges")
        inside = materialise(cuts.polygon_overlaps(segments, edges, keys), "inside")
        for buffer in BUFFERS_M:
            spans = inside if buffer == 0 else inside.unionByName(cuts.edge_overlaps(segments, edges, keys, buffer))
            spans = spans.select(*keys, F.lit(name).alias("vegetation"), F.lit(buffer).alias("buffer_m"), "a", "b")
            found = spans if found is None else found.unionByName(spans)
    return linear.interval_merge(found, [*keys, "vegetation", "buffer_m"])


def _per_buffer(lengths: DataFrame, groups: list[str]) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("vegetation"), F.lit(b).alias("buffer_m")) for n in groups for b in BUFFERS_M])).alias("k")
    return lengths.select("*", kinds).select(*lengths.columns, "k.vegetation", "k.buffer_m")


def buffered_lengths(segments: DataFrame, covers: dict[str, DataFrame], keys: list[str] = ("gid",)) -> DataFrame:
    """Exact route metrics per vegetation group and buffer (see :func:`buffered_spans`)."""
    by = [*keys, "vegetation", "buffer_m"]
    every = _per_buffer(linear.route_lengths(segments, list(keys)), list(covers))
    return linear.overlap_profile(buffered_spans(segments, covers, keys), every, by).withColumnRenamed("route_m", "length_m").select(*by, "length_m", "overlap_m", "overlap_percent", "longest_gap_m", "reconciles")


def buffered_windows(segments: DataFrame, covers: dict[str, DataFrame]) -> DataFrame:
    """Full windows from both ends of every route, per vegetation group and buffer, from exact intervals."""
    every = _per_buffer(linear.route_lengths(segments), list(covers))
    spans = materialise(buffered_spans(segments, covers), "buffered")
    return linear.fixed_windows(spans, every, keys=["gid", "vegetation", "buffer_m"])


def window_summary(windows: DataFrame) -> DataFrame:
    """Per route and buffer: ranges over both anchors, and the median overlap of each anchor."""
    keys = ["gid", "buffer_m"]
    ranges = windows.groupBy(*keys).agg(
        F.min("overlap_percent").alias("overlap_min"), F.max("overlap_percent").alias("overlap_max"),
        F.min("longest_gap_m").alias("gap_min"), F.max("longest_gap_m").alias("gap_max"),
        (F.max("window_index") + 1).cast("bigint").alias("windows_per_anchor"))
    medians = exact_quantiles(windows, [*keys, "anchor"], "overlap_percent", {"m": 0.5}).groupBy(*keys).agg(
        F.max(F.when(F.col("anchor") == "source_start", F.col("m"))).alias("median_from_start"),
        F.max(F.when(F.col("anchor") == "source_end", F.col("m"))).alias("median_from_end"))
    return ranges.join(medians, keys)


def stratum_lengths(metrics: DataFrame) -> DataFrame:
    """Overlap, proximity-only and remaining length per route from its 0 m and 5 m rows."""
    wide = metrics.groupBy("gid").agg(
        F.max("length_m").alias("length_m"), (F.max("length_m") == F.min("length_m")).alias("one_length"),
        *[F.max(F.when(F.col("buffer_m") == b, F.col("overlap_m"))).alias(f"o{int(b)}") for b in BUFFERS_M])
    monotone = F.col("o2").isNull() | ((F.col("o2") >= F.col("o0") - 1e-9) & (F.col("o5") >= F.col("o2") - 1e-9))
    valid = F.col("one_length") & F.coalesce((F.col("o5") >= F.col("o0") - 1e-9) & (F.col("length_m") >= F.col("o5") - 1e-9) & monotone, F.lit(False))
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    return wide.select("gid", "length_m", floor0(F.col("o0")).alias("mapped_overlap"), floor0(F.col("o5") - F.col("o0")).alias("proximity_only"),
                       floor0(F.col("length_m") - F.col("o5")).alias("mapped_non_overlap"), valid.alias("valid"))


STRATA = ("mapped_overlap", "proximity_only", "mapped_non_overlap")


def strata_long(lengths: DataFrame) -> DataFrame:
    """Total length per stratum as rows."""
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).alias("v")) for s in STRATA])).alias("p")
    return lengths.select(parts).groupBy(F.col("p.stratum").alias("stratum")).agg(F.sum("p.v").alias("length_m"))


def frame_reconcile(points: DataFrame, intervals: DataFrame, step: float) -> DataFrame:
    """Per stratum: point-count length against measured length, with the allowed difference."""
    counted = points.groupBy("stratum").agg((F.count("*") * step).alias("frame_m"))
    joined = intervals.withColumnRenamed("length_m", "interval_m").join(counted, "stratum", "full").fillna(0.0, ["frame_m", "interval_m"])
    difference = F.col("frame_m") - F.col("interval_m")
    tolerance = F.greatest(F.lit(float(step)), 0.01 * F.col("interval_m"))
    return joined.select("stratum", "frame_m", "interval_m", difference.alias("difference_m"), (F.abs(difference) <= tolerance).alias("within_tolerance"))


def variant_delta(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Difference of the same measures between two cover variants."""
    other = right.select(*keys, *[F.col(m).alias(f"_{m}") for m in measures])
    return left.join(other, keys).select(*keys, *[(F.col(f"_{m}") - F.col(m)).alias(f"{m}_delta") for m in measures])


def pooled_share(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Length-weighted overlap share over routes."""
    return metrics.groupBy(*keys).agg((100 * F.sum("overlap_m") / F.sum("length_m")).alias("share_percent"))


def date_prefix_shares(routes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Per prefix: share of the length of all routes whose ``begin_date`` (text) starts with it; a route counts once, however many rows it has.

    ``routes`` has ``gid, begin_date, length_m``; of a route with several rows the first by date and length counts. No date is no prefix.
    """
    single = routes.groupBy("gid").agg(F.min(F.struct("begin_date", "length_m")).alias("r")).select("r.*")
    spread = single.select("length_m", F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.coalesce(F.col("begin_date").startswith(p), F.lit(False)).alias("hit")) for p in prefixes])).alias("p"))
    met = F.coalesce(F.sum(F.when(F.col("p.hit"), F.col("length_m"))), F.lit(0.0))
    return spread.groupBy(F.col("p.prefix").alias("prefix")).agg((100 * F.try_divide(met, F.sum("length_m"))).alias("share_percent"))


def stratum_shares(points: DataFrame, step: float) -> DataFrame:
    """Per stratum of a validation frame: its length and its share of the assessed length, points standing for ``step`` metres each."""
    counts = points.groupBy("stratum").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("_t", total).select("stratum", (F.col("n") * step).alias("length_m"), (100.0 * F.col("n") / F.col("_t")).alias("share_percent"))


def segment_shares(points: DataFrame, stratum: str = STRATA[0]) -> DataFrame:
    """Per route of a validation frame: the share of its candidates in one stratum."""
    return points.groupBy("gid").agg((100.0 * F.count_if(F.col("stratum") == stratum) / F.count("*")).alias("share_percent"))


def point_interval_gap(point_share: DataFrame, interval_share: DataFrame) -> DataFrame:
    """Worst gap between the point-grid share and the interval share of a route."""
    joined = point_share.select("gid", F.col("share").alias("p")).join(interval_share.select("gid", F.col("share").alias("i")), "gid")
    return joined.agg(F.max(F.abs(F.col("p") - F.col("i"))).alias("worst_gap_pp"), F.count("*").alias("routes"))


def grouped_median_bounds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Smallest and largest group median, with the number of groups."""
    medians = exact_quantiles(df, keys, value, {"m": 0.5})
    return medians.agg(F.min("m").alias("lowest_median"), F.max("m").alias("highest_median"), F.count("*").alias("groups"))


def routes_select(vertices: DataFrame, attributes: DataFrame, bbox: tuple[float, float, float, float], status: int, kind: int, min_length: float) -> DataFrame:
    """Routes of one status and type, long enough and wholly inside a window."""
    segments = linear.route_segments(vertices)
    lengths = linear.route_lengths(segments)
    extent = vertices.groupBy("gid").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    x0, y0, x1, y1 = bbox
    inside = (F.col("x0") >= x0) & (F.col("x1") <= x1) & (F.col("y0") >= y0) & (F.col("y1") <= y1)
    wanted = attributes.where((F.col("status") == status) & (F.col("kind") == kind))
    return lengths.where(F.col("route_m") >= min_length).join(extent.where(inside).select("gid"), "gid", "left_semi").join(wanted.select("gid"), "gid", "left_semi")
