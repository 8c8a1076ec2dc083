"""Joins and set comparisons on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.functions import geo, text
from terrascreen.functions.numbers import rounded
from terrascreen.operators.guards import unique_lookup


def heat_join(nearest: DataFrame, heat: DataFrame) -> DataFrame:
    """Nearest-station rows that have a heat value, with display defaults for missing text; fails on an id with several values."""
    values = unique_lookup(heat, ["id"], ["heat_pixel"])
    return nearest.join(values, "id").withColumns({
        "district": F.coalesce("district", F.lit("Unknown")),
        "street": F.when(text.is_blank(F.col("street")), F.lit("Unnamed street")).otherwise(F.col("street"))})


def raster_point_join(sites: DataFrame, pixels: DataFrame, strict: bool = True) -> DataFrame:
    """Raster value under each site by an equi join on the pixel index.

    The raster uses 0 for missing; with ``strict`` a site outside the raster, without a pixel or
    on a missing pixel fails the query, otherwise it keeps a null value.
    """
    located = geo.with_lambert72(sites, x="_x", y="_y")
    col, row = geo.pixel_index(F.col("_x"), F.col("_y"))
    located = located.withColumns({"col": col, "row": row}).drop("_x", "_y")
    joined = located.join(pixels, ["col", "row"], "left")
    value = F.when(geo.in_raster(F.col("col"), F.col("row")) & (F.col("value") != 0), F.col("value"))
    if strict:
        problem = F.raise_error(F.concat(F.lit("no raster value for "), F.col("id"))).cast("int")
        value = F.when(value.isNotNull(), value).otherwise(problem)
    return joined.select(*sites.columns, "col", "row", value.alias("heat_value"))


def cell_join(sites: DataFrame, cells: DataFrame, metrics: list[str], strict: bool = True) -> DataFrame:
    """Site to snapped grid cell with the metrics of that cell."""
    keyed = sites.withColumn("grid_key", geo.grid_key(F.col("latitude"), F.col("longitude")))
    joined = keyed.join(cells.select("grid_key", *metrics).withColumn("_hit", F.lit(True)), "grid_key", "left")
    if strict:
        known = F.coalesce("_hit", F.lit(False))
        problem = F.raise_error(F.concat(F.lit("no cell for "), F.col("id"))).cast("string")
        joined = joined.withColumn("grid_key", F.when(known, F.col("grid_key")).otherwise(problem))
    return joined.drop("_hit")


def cube_points(sites: DataFrame, x0: float, y0: float, step: float, size: int) -> DataFrame:
    """Nearest cube cell of every site with the offsets from its centre."""
    placed = geo.with_laea(sites, x="_x", y="_y")
    placed = placed.withColumns({"col": geo.axis_index(F.col("_x"), x0, step, size), "row": geo.axis_index(F.col("_y"), y0, step, size)})
    east = geo.axis_offset(F.col("_x"), F.col("col"), x0, step)
    north = geo.axis_offset(F.col("_y"), F.col("row"), y0, step)
    inside = geo.within_half_step(east, step) & geo.within_half_step(north, step)
    return placed.select(*sites.columns, "col", "row", rounded(east, 1).alias("offset_east_m"), rounded(north, 1).alias("offset_north_m"), inside.alias("inside"))


def cube_point_sample(points: DataFrame, cube: DataFrame, keys: list[str] = ("col", "row")) -> DataFrame:
    """Daily series of the cells that sites fall in: the cube is cut to those cells first."""
    keys = list(keys)
    return cube.join(points.select(*keys).distinct(), keys, "left_semi")


def tolerance_join(requested: DataFrame, returned: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Requested against returned grid coordinates per ordinal; ``agrees`` needs unit and day too."""
    joined = requested.join(returned, "ordinal", "left")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    good = (close("latitude", "r_latitude") & close("longitude", "r_longitude") & (F.col("r_unit") == F.col("unit")) & (F.col("r_day") == F.col("day")))
    return joined.withColumn("agrees", F.coalesce(good, F.lit(False)))


def crosswalk_localize(rows: DataFrame, crosswalk: DataFrame, strict: bool = True) -> DataFrame:
    """Replace live ids by their legacy ids; blank pairs of the crosswalk are ignored."""
    pairs = crosswalk.where(~text.is_blank(F.col("legacy_id")) & ~text.is_blank(F.col("live_id"))).select("legacy_id", F.col("live_id").alias("id"))
    joined = rows.join(pairs, "id", "left")
    legacy = F.col("legacy_id")
    if strict:
        problem = F.raise_error(F.concat(F.lit("no crosswalk entry for "), F.coalesce(F.col("id"), F.lit("null"))))
        legacy = F.when(legacy.isNotNull(), legacy).otherwise(problem.cast("string"))
    return joined.select(legacy.alias("id"), *[c for c in rows.columns if c != "id"])


def preserve_sample(rows: DataFrame, committed: DataFrame | None, first_run: int = 100, order: str = "ord") -> DataFrame:
    """Refreshed rows restricted to the committed ids, carrying the committed ordinal.

    A committed id without a row, or given twice, fails; ``guards.kept_sample_violations`` lists them.
    Without committed ids the first ``first_run`` rows in source order are taken.
    """
    if committed is None:
        return rows.orderBy(order).limit(first_run)
    wanted = unique_lookup(committed.select("id", F.col("ord").alias("committed_ord")), ["id"], ["committed_ord"])
    found = wanted.join(rows.withColumn("_hit", F.lit(True)), "id", "left")
    lost = F.raise_error(F.concat(F.lit("no row for committed id "), F.col("id"))).cast("boolean")
    kept = found.where(F.when(F.col("_hit").isNull(), lost).otherwise(True))
    return kept.select(*rows.columns, "committed_ord")


def missing_ids(committed: DataFrame, rows: DataFrame) -> DataFrame:
    return committed.join(rows.select("id"), "id", "left_anti")


def label_key(gid: Column, chainage: Column) -> Column:
    """Equality key for (route, chainage at 6 decimals) without comparing doubles."""
    return F.struct(gid.cast("bigint").alias("gid"), F.rint(chainage * 1e6).cast("bigint").alias("micro"))


def label_frame_join(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """Label rows with the stratum of the frame point they name; never snapped to a neighbour.

    ``status`` tells a usable label from a duplicate and from one that names no candidate.
    """
    keyed = labels.withColumn("_k", label_key(F.col("gid"), F.col("chainage")))
    uses = keyed.groupBy("_k").agg(F.count("*").alias("_uses"))
    points = frame.select(label_key(F.col("gid"), F.col("chainage")).alias("_k"), "stratum")
    joined = keyed.join(uses, "_k").join(points, "_k", "left")
    status = F.when(F.col("stratum").isNull(), "not_a_candidate").when(F.col("_uses") > 1, "duplicate").otherwise("ok")
    return joined.select(*labels.columns, "stratum", status.alias("status"))


def unmatched_audit(sites: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Long table (stage, id, ord): sites missing from each stage's id table."""
    parts = [sites.select("id", "ord").join(ids.select("id"), "id", "left_anti").select(F.lit(stage).alias("stage"), "id", "ord")
             for stage, ids in stages.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def id_set_equality(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Symmetric difference of two id sets, naming the side that has the id."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    joined = a.join(b, key, "full")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    return joined.select(key, side.alias("side")).where(F.col("side").isNotNull())


def paired_series(first: DataFrame, second: DataFrame, keys: list[str], tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Two series over the same support: the paired rows, and the violations of the pairing."""
    joined = first.select(*keys, F.col("val").alias("first_val")).join(second.select(*keys, F.col("val").alias("second_val")), keys, "full")
    delta = F.col("second_val") - F.col("first_val")
    problem = (F.when(F.col("first_val").isNull(), "missing_first").when(F.col("second_val").isNull(), "missing_second")
               .when(delta < -tolerance, "second_below_first"))
    marked = joined.withColumns({"delta": delta, "problem": problem})
    return marked.where(F.col("problem").isNull()).drop("problem"), marked.where(F.col("problem").isNotNull()).select(*keys, "problem")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Share of exactly equal pairs, smallest difference, count and whether all pairs are equal."""
    return pairs.agg(
        F.count("*").alias("paired"), rounded(F.min("delta"), 9).alias("min_delta"),
        rounded(F.avg(F.when(F.col("delta") == 0, 1.0).otherwise(0.0)), 9).alias("zero_fraction"),
        (F.count_if(F.col("delta") != 0) == 0).alias("all_equal"))


def set_overlap(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key: sizes, intersection, union and Jaccard share of two item sets."""
    both = (left.select(*keys, item).distinct().withColumns({"l": F.lit(1), "r": F.lit(0)})
            .unionByName(right.select(*keys, item).distinct().withColumns({"l": F.lit(0), "r": F.lit(1)})))
    items = both.groupBy(*keys, item).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    counts = items.groupBy(*keys).agg(
        F.sum("l").alias("left_size"), F.sum("r").alias("right_size"), F.sum(F.col("l") * F.col("r")).alias("overlap"), F.count("*").alias("union_size"))
    return counts.withColumn("jaccard", F.try_divide(F.col("overlap").cast("double"), F.col("union_size")))


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that are expected but missing, and keys that are present but unknown."""
    gone = expected.select(key).distinct().join(actual.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    return gone.unionByName(extra)
