"""Linear referencing along routes: segments, chainage grids, intervals, gaps and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascreen.operators.ordering import BLOCK, blocked_scan, changes, materialise, ordered_blocks, ordered_pass

# Shortest interval kept, largest gap bridged and reconciliation tolerance, metres.
DROP_M, JOIN_M, RECONCILE_M = 1e-9, 1e-8, 1e-6
CHAINAGE_STEP_M, WINDOW_M, TILE_M = 2.0, 100.0, 50.0


def route_segments(vertices: DataFrame, keys: list[str] = ("gid",)) -> DataFrame:
    """Segments ``x1,y1,x2,y2,len`` with the ``offset`` where each starts and the route length."""
    keys = list(keys)
    blocks = ordered_blocks(vertices.select(*keys, "seq", "x", "y"), [*[F.col(k) for k in keys], F.col("seq")], "vertices")
    linked = blocked_scan(blocks, keys, {"p": ("previous", F.struct("x", "y"))})
    dx, dy = F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")
    linked = linked.withColumn("len", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    placed = blocked_scan(linked, keys, {"offset": ("sum", F.col("len"))}, {"route_m": F.col("len")})
    return placed.where(F.col("p").isNotNull() & (F.col("len") > 0)).select(
        *keys, (F.col("seq") - 1).alias("part"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"),
        F.col("x").alias("x2"), F.col("y").alias("y2"), "len", "offset", "route_m")


def route_lengths(segments: DataFrame, keys: list[str] = ("gid",)) -> DataFrame:
    return segments.groupBy(*keys).agg(F.max("route_m").alias("route_m"))


def chainage_grid(segments: DataFrame, step: float = CHAINAGE_STEP_M, keys: list[str] = ("gid",)) -> DataFrame:
    """Candidate midpoints every ``step`` metres; the incomplete remainder is left out.

    Each segment generates its own chainages, so no range join is needed.
    """
    first = F.ceil(F.col("offset") / step - 0.5)
    last = F.ceil((F.col("offset") + F.col("len")) / step - 0.5) - 1
    last = F.least(last, F.floor(F.col("route_m") / step) - 1)
    grid = segments.where(last >= first).withColumn("idx", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    chainage = (F.col("idx") + 0.5) * step
    share = (chainage - F.col("offset")) / F.col("len")
    return grid.select(*keys, "idx", chainage.alias("chainage"),
                       (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("x"),
                       (F.col("y1") + share * (F.col("y2") - F.col("y1"))).alias("y"), "route_m")


def interval_merge(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Union of intervals ``a..b`` per key: slivers dropped, touching ones joined.

    Intervals are put in order, also by their ends, so a pile at one start is cut over blocks; each block is merged in one pass. Only a block's first and last
    key can go on in another block, so only what their blocks have left of them is merged once more, by running maxima over the blocks.
    """
    keys = list(keys)
    kept = materialise(intervals.where(F.col("b") - F.col("a") > DROP_M).select(*keys, "a", "b"), "intervals")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, group, position = None, 0, 0  # the island that may go on, its key's number in the block, rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _stacked(open_one, batch, [*keys, "a", "b"])
            a, b = (table.column(c).to_numpy() for c in ("a", "b"))
            n = len(a)
            fresh = changes([table.column(k) for k in keys]) if keys else np.arange(n) == 0
            number = np.cumsum(fresh) - 1
            # Running maximum within a key: ranks of the ends, raised from key to key.
            by_end = np.argsort(b, kind="stable")
            rank = np.empty(n, np.int64)
            rank[by_end] = np.arange(n)
            reach = b[by_end[np.maximum.accumulate(number * n + rank) % n]]
            before = np.r_[np.nan, reach[:-1]]
            opens = fresh | (a > before + JOIN_M) | (np.isnan(a) & ~np.isnan(before))
            starts = np.flatnonzero(opens)
            ends = np.r_[starts[1:], n] - 1
            islands = table.select(keys).take(pa.array(starts)).append_column("a", pa.array(a[starts])).append_column("b", pa.array(reach[ends]))
            numbers = group + number[starts]
            open_one, group = islands.slice(len(starts) - 1).combine_chunks().to_batches()[0], int(numbers[-1])
            if len(starts) > 1:
                done = islands.slice(0, len(starts) - 1).append_column("_pos", pa.array(position + np.arange(len(starts) - 1))).append_column("_g", pa.array(numbers[:-1]))
                position += len(starts) - 1
                yield from done.combine_chunks().to_batches()
        if open_one is not None:
            yield pa.RecordBatch.from_arrays([*open_one.columns, pa.array([position]), pa.array([group])], [*open_one.schema.names, "_pos", "_g"])

    islands = ordered_pass(kept, keys, [*[F.col(k) for k in keys], F.col("a"), F.col("b")], merge, "a double, b double, _pos long, _g long", "islands")
    # One row per block: their number is that of the partitions.
    last = islands.groupBy(BLOCK).agg(F.max("_g").alias("_last"))
    islands = islands.join(F.broadcast(last), BLOCK)
    at_edge = (F.col("_g") == 0) | (F.col("_g") == F.col("_last"))
    blocks = materialise(islands.where(at_edge).select(*keys, "a", "b", BLOCK, "_pos"), "edge-islands")
    reached = blocked_scan(blocks, keys, {"reach": ("max", F.col("b"))})
    opens = F.col("reach").isNull() | (F.col("a") > F.col("reach") + JOIN_M)
    flagged = reached.withColumn("start", F.when(opens, F.col("a")))
    filled = blocked_scan(flagged, keys, {"earlier": ("max", F.col("start"))})
    island = F.coalesce(F.col("start"), F.col("earlier"))
    linked = filled.groupBy(*keys, island.alias("_start")).agg(F.max("b").alias("b")).withColumnRenamed("_start", "a")
    return islands.where(~at_edge).select(*keys, "a", "b").unionByName(linked.select(*keys, "a", "b"))


def reversed_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals that end before they start; callers treat any row as an error."""
    return intervals.where((F.col("b") < F.col("a")) | F.isnan("a") | F.isnan("b")).select(*keys, "a", "b")


def interval_gaps(merged: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Complement of merged intervals on ``[0, route_m]``; a route without intervals is one gap."""
    keys = list(keys)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_key = None, True  # the row before; whether the block's first key goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _stacked(last, batch, [*keys, "a", "b"])
            a, b = (table.column(c).to_numpy() for c in ("a", "b"))
            fresh = changes([table.column(k) for k in keys]) if keys else np.arange(len(a)) == 0
            prior = np.where(fresh, 0.0, np.r_[0.0, b[:-1]])
            gap = a > prior + JOIN_M
            # The block's first row goes on from an earlier block if its key does; it is settled below, as is its last row.
            known = slice(1, None)
            if last is None:
                yield from _marked(table.slice(0, 1), keys, a[:1], b[:1], "first")
            chosen = np.flatnonzero(gap[known]) + 1
            if len(chosen):
                yield from _marked(table.select(keys).take(pa.array(chosen)), keys, prior[chosen], a[chosen], "gap")
            last = table.slice(len(a) - 1).combine_chunks().to_batches()[0]
        if last is not None:
            yield from _marked(pa.Table.from_batches([last]), keys, last.column("a").to_numpy(), last.column("b").to_numpy(), "last")

    found = ordered_pass(merged.select(*keys, "a", "b"), keys, [*[F.col(k) for k in keys], F.col("a")], between, "a double, b double, kind string", "gaps")
    # Two rows per block; a key's blocks in order, each with what the one before ends with.
    edges = found.where("kind <> 'gap'")
    earlier = F.lag("b").over(Window.partitionBy(*keys).orderBy(BLOCK, "kind"))
    resumed = edges.withColumn("prior", F.coalesce(earlier, F.lit(0.0))).where("kind = 'first'").select(*keys, F.col("prior").alias("a"), F.col("a").alias("b"))
    inner = found.where("kind = 'gap'").select(*keys, "a", "b").unionByName(resumed)
    ends = merged.groupBy(*keys).agg(F.max("b").alias("end"))
    tail = lengths.join(ends.hint("merge"), keys, "left").select(*keys, F.coalesce("end", F.lit(0.0)).alias("a"), F.col("route_m").alias("b"))
    return inner.unionByName(tail).where(F.col("b") > F.col("a") + JOIN_M)


def _stacked(before: pa.RecordBatch | None, batch: pa.RecordBatch, names: list[str]) -> pa.Table:
    """The named columns of ``batch`` below the row kept from before; all may hold nulls, so that every part has one schema."""
    parts = [p for p in (before, batch) if p is not None]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([p.column(n) for n in names], names) for p in parts])


def _marked(table: pa.Table, keys: list[str], a: np.ndarray, b: np.ndarray, kind: str) -> list[pa.RecordBatch]:
    named = table.select(keys).append_column("a", pa.array(a)) if keys else pa.table({"a": a})
    return named.append_column("b", pa.array(b)).append_column("kind", pa.array([kind] * len(a))).combine_chunks().to_batches()


def overlap_profile(merged: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: overlap, its share, the longest gap and whether the parts add up to the length."""
    merged = materialise(merged.select(*keys, "a", "b"), "overlaps")
    gaps = interval_gaps(merged, lengths, keys).groupBy(*keys).agg(F.max(F.col("b") - F.col("a")).alias("_gap"), F.sum(F.col("b") - F.col("a")).alias("_gaps"))
    covered = merged.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("_over"))
    joined = lengths.join(covered.hint("merge"), keys, "left").join(gaps.hint("merge"), keys, "left")
    over, gap = F.coalesce("_over", F.lit(0.0)), F.coalesce("_gaps", F.lit(0.0))
    return joined.select(
        *lengths.columns, over.alias("overlap_m"), (100 * over / F.col("route_m")).alias("overlap_percent"),
        F.coalesce("_gap", F.lit(0.0)).alias("longest_gap_m"), (F.abs(over + gap - F.col("route_m")) <= RECONCILE_M).alias("reconciles"))


def box_overlaps(segments: DataFrame, boxes: DataFrame, keys: list[str], box_keys: list[str] = (), tile_m: float = TILE_M) -> DataFrame:
    """Intervals of each route covered by axis-parallel boxes (boundary contact has no length).

    Segments are cut into tile-sized pieces, pieces and boxes meet on tiles, and each pair is
    clipped parametrically; the pieces of one overlap touch and are joined by the merge.
    """
    tile = lambda v: F.floor(v / F.lit(tile_m)).cast("bigint")
    pieces = dealt(segments).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / tile_m).cast("int"))))
    pieces = pieces.withColumns({"s0": F.col("piece") * F.lit(tile_m), "s1": F.least((F.col("piece") + 1) * F.lit(tile_m), F.col("len"))})
    at = lambda s, axis: F.col(f"{axis}1") + s / F.col("len") * (F.col(f"{axis}2") - F.col(f"{axis}1"))
    spans = {}
    for axis in ("x", "y"):
        ends = at(F.col("s0"), axis), at(F.col("s1"), axis)
        spans |= {f"{axis}_low": F.least(*ends) - 1e-6, f"{axis}_high": F.greatest(*ends) + 1e-6, f"d{axis}": F.nullif(F.col(f"{axis}2") - F.col(f"{axis}1"), F.lit(0.0))}
    pieces = pieces.withColumns(spans).select(*keys, "offset", "len", "s0", "s1", "x1", "y1", *spans)
    span = lambda axis: F.explode(F.sequence(tile(F.col(f"{axis}_low")), tile(F.col(f"{axis}_high"))))
    pieces = pieces.withColumn("tx", span("x")).withColumn("ty", span("y"))
    renamed = boxes.select(*box_keys, *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    tiled = renamed.withColumn("tx", F.explode(F.sequence(tile(F.col("b_x1")), tile(F.col("b_x2")))))
    tiled = tiled.withColumn("ty", F.explode(F.sequence(tile(F.col("b_y1")), tile(F.col("b_y2")))))
    pairs = met_on_tiles(pieces, tiled)
    for axis in ("x", "y"):
        one, two, level = F.col(f"b_{axis}1"), F.col(f"b_{axis}2"), F.col(f"{axis}1")
        pairs = pairs.where(F.least(one, two) <= F.col(f"{axis}_high")).where(F.greatest(one, two) >= F.col(f"{axis}_low"))
        # A line that keeps one coordinate is between the sides everywhere or nowhere.
        pairs = pairs.where(F.col(f"d{axis}").isNotNull() | ((one <= level) & (two >= level)))
    # The row number keeps later tests where they are: below the join they would hold the whole formula once more for each of its uses.
    pairs = pairs.withColumn("_row", F.monotonically_increasing_id())
    share = lambda axis, side: F.try_divide(F.col(f"b_{axis}{side}") - F.col(f"{axis}1"), F.col(f"d{axis}"))
    pairs = pairs.select(*keys, *box_keys, "_row", "offset", "len", "s0", "s1", *[share(axis, side).alias(f"{axis}t{side}") for axis in ("x", "y") for side in (1, 2)])
    t0 = F.greatest(F.least("xt1", "xt2"), F.least("yt1", "yt2"), F.lit(0.0))
    t1 = F.least(F.greatest("xt1", "xt2"), F.greatest("yt1", "yt2"), F.lit(1.0))
    pairs = pairs.select(*keys, *box_keys, "_row", "offset", F.greatest(t0 * F.col("len"), F.col("s0")).alias("a"), F.least(t1 * F.col("len"), F.col("s1")).alias("b"))
    return pairs.where((F.col("b") > F.col("a")) & (F.col("_row") >= 0)).select(
        *keys, *box_keys, (F.col("offset") + F.col("a")).alias("a"), (F.col("offset") + F.col("b")).alias("b"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small table that each make many, over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a side of a tile join that are sent to every task; planned sizes do not see what an explode makes of a small table.
SENT_ROWS = 50_000


def met_on_tiles(pieces: DataFrame, tiled: DataFrame, on: list[str] = ("tx", "ty")) -> DataFrame:
    """``pieces`` joined to ``tiled`` on tiles: the written ``tiled`` goes to every task if it has few rows, else both are shuffled and sorted."""
    tiled = materialise(tiled, "tiled")
    few = tiled.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return pieces.join(F.broadcast(tiled) if few else tiled.hint("merge"), list(on))


def fixed_windows(merged: DataFrame, lengths: DataFrame, window_m: float = WINDOW_M, keys: list[str] = ("gid",)) -> DataFrame:
    """Full windows counted from each end: overlap share and longest gap inside every window.

    An interval generates the windows it touches, so a window only ever sees its own intervals.
    """
    keys = list(keys)
    anchors = F.explode(F.array(F.lit("source_start"), F.lit("source_end")))
    count = F.floor(F.col("route_m") / window_m).cast("int")
    frames = lengths.where(count > 0).withColumn("anchor", anchors).withColumn(
        "window_index", F.explode(F.sequence(F.lit(0), count - 1)))
    oriented = merged.join(lengths, keys).withColumn("anchor", anchors)
    back = F.col("anchor") == "source_end"
    oriented = oriented.withColumns({"a": F.when(back, F.col("route_m") - F.col("b")).otherwise(F.col("a")),
                                     "b": F.when(back, F.col("route_m") - F.col("a")).otherwise(F.col("b"))})
    first = F.greatest(F.floor(F.col("a") / window_m), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("b") / window_m), count - 1).cast("int")
    clipped = oriented.where(last >= first).withColumn("window_index", F.explode(F.sequence(first, last)))
    start = F.col("window_index") * F.lit(window_m)
    clipped = clipped.withColumns({"a": F.greatest(F.col("a"), start) - start, "b": F.least(F.col("b"), start + window_m) - start})
    clipped = clipped.where(F.col("b") - F.col("a") > DROP_M).select(*keys, "anchor", "window_index", "a", "b")
    whole = frames.select(*keys, "anchor", "window_index", F.lit(float(window_m)).alias("route_m"))
    profile = overlap_profile(clipped, whole, [*keys, "anchor", "window_index"])
    return profile.withColumns({"start_m": F.col("window_index") * F.lit(window_m), "end_m": (F.col("window_index") + 1) * F.lit(window_m)})


def runs(points: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Runs of equal values in order: ``keys, run_start, value, n``."""
    marked = points.select(*keys, F.col(order).alias("_o"), value.alias("value"))
    blocks = ordered_blocks(marked, [*[F.col(k) for k in keys], F.col("_o")], "runs")
    linked = blocked_scan(blocks, keys, {"p": ("previous", F.struct("value"))})
    changed = F.col("p").isNull() | ~F.col("p.value").eqNullSafe(F.col("value"))
    flagged = linked.withColumn("start", F.when(changed, F.col("_o")))
    filled = blocked_scan(flagged, keys, {"earlier": ("max", F.col("start"))})
    start = F.coalesce(F.col("start"), F.col("earlier"))
    return filled.groupBy(*keys, start.alias("run_start")).agg(F.any_value("value").alias("value"), F.count("*").alias("n"))


def boundary_crossings(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Changes of value between neighbours, per key; zero kept."""
    blocks = ordered_blocks(points.select(*keys, order, value), [*[F.col(k) for k in keys], F.col(order)], "crossings")
    linked = blocked_scan(blocks, keys, {"p": ("previous", F.struct(value))})
    changed = F.col("p").isNotNull() & ~F.col(f"p.{value}").eqNullSafe(F.col(value))
    return linked.groupBy(*keys).agg(F.count_if(changed).alias("crossings"))


