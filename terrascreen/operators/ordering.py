"""Ordered computation without one-task windows.

A plain window sends each whole group to one task, so a group holding a third of the rows
becomes the job. Here rows are range-partitioned on the full ordering (which splits a hot
group over many tasks), each partition becomes a block, and running values are the value
inside the block plus a carry from the blocks before it. The block number is written out with
the rows, because a range partitioning that is computed twice may cut in different places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascreen.session import scratch_path

BLOCK, POSITION = "_block", "_pos"
_ROW_BITS = (1 << 33) - 1


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back, cutting the lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_blocks(df: DataFrame, order: Sequence[Column], label: str = "blocks") -> DataFrame:
    """Rows in range-partitioned blocks: ``_block`` ascends with the order, ``_pos`` within it."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = spread.withColumns({
        BLOCK: F.spark_partition_id(),
        POSITION: F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
    })
    return materialise(marked, label)


def ordered_pass(df: DataFrame, keys: Sequence[str], order: Sequence[Column], function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                 schema: str, label: str) -> DataFrame:
    """``function`` over the rows of each block in order (see :func:`ordered_blocks`), written; each block is read once, in one task.

    Rows come out as ``keys``, then the columns of ``schema``, with ``_block`` added. Only a block's first and last key can reach into another block.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return materialise(spread.mapInArrow(function, f"{key_schema}, {schema}").withColumn(BLOCK, F.spark_partition_id()), label)


def changes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """Which rows have other values in some column than the row before; the first row has. Nulls are equal."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for column in columns:
        now, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        other = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
        lost = pc.is_null(now).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False)
        first[1:] |= other | lost
    return first


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    match = F.lit(True)
    for name in names:
        match = match & left[name].eqNullSafe(renamed[f"_r_{name}"])
    return left.join(renamed, match, how).drop(*[f"_r_{n}" for n in names])


def blocked_scan(blocks: DataFrame, keys: Sequence[str], scans: Mapping[str, tuple[str, Column]],
                 totals: Mapping[str, Column] | None = None) -> DataFrame:
    """Exclusive running values within ``keys`` over an :func:`ordered_blocks` table.

    ``scans`` maps an output name to ``("sum" | "max" | "min" | "previous", value)``;
    ``totals`` adds per-key sums. The carry table has one row per key and block. Rows with a
    null key form a group of their own, as in a SQL window.
    """
    totals = totals or {}
    summary_aggs, carries = [], {}
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, value) in scans.items():
        part = F.max_by(F.struct(value.alias("v")), F.col(POSITION)) if kind == "previous" else getattr(F, kind)(value)
        summary_aggs.append(part.alias(f"_s_{name}"))
        carries[f"_c_{name}"] = (F.lag(f"_s_{name}").over(by_block) if kind == "previous"
                                 else getattr(F, kind)(f"_s_{name}").over(before))
    for name, value in totals.items():
        summary_aggs.append(F.sum(value).alias(f"_s_{name}"))
        carries[name] = F.sum(f"_s_{name}").over(Window.partitionBy(*keys))
    carry = blocks.groupBy(*keys, BLOCK).agg(*summary_aggs).withColumns(carries)
    carry = carry.select(*keys, BLOCK, *[F.col(c) for c in carries])

    local = Window.partitionBy(*keys, BLOCK).orderBy(POSITION)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"_l_{name}": (F.lag(F.struct(value.alias("v"))).over(local) if kind == "previous"
                             else getattr(F, kind)(value).over(earlier)) for name, (kind, value) in scans.items()}
    joined = _null_safe(blocks.withColumns(inside), carry, [*keys, BLOCK])
    results = {}
    for name, (kind, _) in scans.items():
        a, b = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "previous":
            results[name] = F.coalesce(a, b)["v"]
        elif kind == "sum":
            results[name] = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            results[name] = (F.greatest if kind == "max" else F.least)(a, b)
    return joined.withColumns(results).drop(*inside, *[c for c in carries if c.startswith("_c_")])


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position within ``keys``; the block of each row is kept."""
    blocks = ordered_blocks(df, [*[F.col(k) for k in keys], *order], f"ordinal-{name}")
    carry = blocks.groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"), F.min(POSITION).alias("_p0"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = _null_safe(blocks, carry, [*keys, BLOCK])
    position = F.col("_before") + F.col(POSITION) - F.col("_p0") + 1
    return ranked.withColumn(name, position.cast("bigint")).drop("_before", "_p0", POSITION)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position within ``keys`` under a total order; the rows themselves are sorted once.

    Null keys are a group of their own, null values stand where the given order puts them.
    """
    return _numbered(df, keys, order, name).drop(BLOCK)


def tied_positions(df: DataFrame, keys: Sequence[str], value: str, items: Sequence[Column] = (), name: str = "pos") -> DataFrame:
    """Positions by descending ``value`` (nulls last, then ``items``), with the first and last position of each tie.

    Adds ``name``, ``{name}_first`` and ``{name}_last``. A tie is found per block first, and its few
    block rows are brought together, so a value that most rows share stays spread over its blocks.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    ranked = _numbered(rows, keys, [F.desc_nulls_last(value), *items, F.col("_tie")], name).drop("_tie")
    parts = ranked.groupBy(*keys, value, BLOCK).agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
    tie = Window.partitionBy(*keys, value)  # one row per block that the tie reaches
    parts = parts.withColumns({f"{name}_first": F.min("_lo").over(tie), f"{name}_last": F.max("_hi").over(tie)}).drop("_lo", "_hi")
    return _null_safe(ranked, parts, [*keys, value, BLOCK]).drop(BLOCK)


def running_counts(df: DataFrame, keys: Sequence[str], value: str, bounded: bool, descending: bool = False) -> DataFrame:
    """Histogram rows ``keys, value, n`` with ``before`` (rows ordered earlier) and ``total``.

    With ``bounded`` the number of distinct values per key has a fixed limit (a rounded score,
    a calendar), so a window over the histogram is safe; otherwise blocks are used.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    if bounded:
        window = Window.partitionBy(*keys)
        before = F.sum("n").over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return hist.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(window)})
    blocks = ordered_blocks(hist, [*[F.col(k) for k in keys], order], "histogram")
    scanned = blocked_scan(blocks, keys, {"before": ("sum", F.col("n"))}, {"total": F.col("n")})
    return scanned.drop(BLOCK, POSITION)


#: Split points of a narrowing step, and the rank accuracy they are taken with; a key of up to this many values is sorted as it is.
SPLITS, ACCURACY, FEW = 256, 1024, 4096


def selected(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """Values at given 0-based ranks per key (``rank`` is a column of the key's number of values ``n``): ``keys, n`` and a column per rank.

    Keys of up to ``FEW`` values are sorted one by one, which bounds a list. Of others nothing is sorted: a sketch proposes a few values around each rank, an exact count of what lies below and at them either finds the rank or
    narrows the range, and so on. Rows meet the ranges where they are, sketches and counts move; a step leaves about a hundredth of the rows in
    range. The least and the greatest value of a range are always among the proposed ones, so every step narrows. Nulls have no rank.
    """
    names = list(ranks)
    own = [*keys] or ["_g"]
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    values = materialise(values if keys else values.withColumn("_g", F.lit(0)), "values")
    totals = materialise(values.groupBy(*own).agg(F.count("*").alias("n")), "totals")
    crowded = totals.where(F.col("n") > FEW)
    many = not crowded.isEmpty()
    few = _null_safe(values, totals.where(F.col("n") <= FEW).select(*own), own) if many else values
    lists = few.groupBy(*own).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_v")).alias("_s"))
    sorted_ones = lists.select(*keys, "n", *[F.get("_s", rank.cast("int")).alias(name) for name, rank in ranks.items()])
    if not many and keys:
        return sorted_ones
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("t"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])).alias("w")
    none = F.lit(None).cast(values.schema["_v"].dataType)
    totals = crowded if keys else totals
    open_ones = materialise(totals.select(*own, "n", wanted).select(*own, "n", "w.t", "w.rank", none.alias("low"), none.alias("high")), "ranges")
    done = []
    while not open_ones.isEmpty():
        within = (F.col("low").isNull() | (F.col("_v") > F.col("low"))) & (F.col("high").isNull() | (F.col("_v") < F.col("high")))
        here = [*own, "n", "t", "rank", "low", "high"]
        grid = F.percentile_approx("_v", [k / SPLITS for k in range(SPLITS + 1)], ACCURACY)
        sketch = _null_safe(values, open_ones, own).where(within).groupBy(*here).agg(F.count("*").alias("m"), F.min("_v").alias("_first"), F.max("_v").alias("_last"), grid.alias("grid"))
        at = F.floor((F.col("rank") + 0.5) / F.col("m") * SPLITS).cast("int")
        near = [F.get("grid", F.greatest(F.least(at + shift, F.lit(SPLITS)), F.lit(0))) for shift in (-1, 0, 1, 2)]
        probes = F.array_sort(F.array_distinct(F.array("_first", *near, "_last")))
        proposed = materialise(sketch.select(*here, probes.alias("probes")), "probes")
        met = _null_safe(values, proposed, own).where(within)
        probe = [F.get("probes", F.lit(k)) for k in range(len(near) + 2)]
        counted = met.groupBy(*here).agg(F.any_value("probes").alias("probes"), F.array(*[F.count_if(F.col("_v") < p) for p in probe]).alias("below"), F.array(*[F.count_if(F.col("_v") == p) for p in probe]).alias("same"))
        each = counted.select(*here, F.explode(F.arrays_zip("probes", "below", "same")).alias("c")).where("c.probes is not null").select(*here, F.col("c.probes").alias("probe"), "c.below", "c.same")
        past, over = F.col("below") + F.col("same") <= F.col("rank"), F.col("below") > F.col("rank")
        step = each.groupBy(*here).agg(
            F.max(F.when(~past & ~over, F.col("probe"))).alias("hit"), F.max(F.when(past, F.struct("probe", (F.col("below") + F.col("same")).alias("gone")))).alias("under"),
            F.min(F.when(over, F.col("probe"))).alias("above"))
        step = materialise(step, "narrowed")
        done.append(step.where("hit is not null").select(*own, "n", "t", F.col("hit").alias("found")))
        open_ones = step.where("hit is null").select(
            *own, "n", "t", (F.col("rank") - F.coalesce("under.gone", F.lit(0))).alias("rank"), F.coalesce("under.probe", "low").alias("low"), F.coalesce("above", "high").alias("high"))
    found = values.select(*own, F.lit(0).cast("bigint").alias("n"), F.lit("").alias("t"), F.col("_v").alias("found")).where("false")
    for part in done:
        found = found.unionByName(part)
    columns = [F.max("n").alias("n"), *[F.max(F.when(F.col("t") == name, F.col("found"))).alias(name) for name in names]]
    return found.groupBy(*keys).agg(*columns).unionByName(sorted_ones) if keys else found.agg(*columns)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                    bounded: bool = False, nearest_rank: bool = False) -> DataFrame:
    """Exact quantiles per key: linear interpolation between order statistics, or with ``nearest_rank`` the ``ceil(p n)``-th smallest value.

    With ``bounded`` (see :func:`running_counts`) they are read off the histogram, otherwise selected by narrowing ranges.
    """
    n = F.col("n")
    if nearest_rank:
        ranks = {name: F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0)) for name, p in probs.items()}
        results = [F.col(name) for name in probs]
    else:
        exact = {name: (n - 1) * F.lit(p) for name, p in probs.items()}
        ranks = {f"{name}_{end}": getattr(F, end)(e) for name, e in exact.items() for end in ("floor", "ceil")}
        between = lambda name: F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (exact[name] - F.floor(exact[name]))
        results = [between(name).alias(name) for name in probs]
    if not bounded:
        return selected(df, keys, value, ranks).select(*keys, *results)
    hist = running_counts(df, keys, value, True).withColumnRenamed("n", "_n").withColumnRenamed("total", "n")
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("_n")), F.col(value)))
    aggs = [F.max("n").alias("_total"), *[at(rank).alias(name) for name, rank in ranks.items()]]
    grouped = hist.groupBy(*keys).agg(*aggs) if keys else hist.agg(*aggs)
    return grouped.withColumnRenamed("_total", "n").select(*keys, *results)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key for a small literal ``k``.

    The rank filter is applied inside every task before the shuffle, so only ``k`` rows per
    task and key move; without keys it is a plain ordered limit.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if keys:
        return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    best = df.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)))
