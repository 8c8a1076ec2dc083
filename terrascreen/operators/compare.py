"""How two rankings of the same items agree, and how that agreement reacts to choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.functions.numbers import rounded
from terrascreen.operators.ordering import materialise, ordinal, tied_positions

# Selection shares in percent, decimals kept and members required.
SELECTION_PERCENT, DECIMALS, MINIMUM_MEMBERS = (10, 20, 25, 33, 50), (2, 1, 0), (1, 2, 3)


def selection_k(n: Column, percent: Column | int) -> Column:
    """At least one item, otherwise the share of ``n`` rounded up."""
    p = F.lit(percent) if isinstance(percent, int) else percent
    return F.greatest(F.lit(1), F.ceil(n * p / 100)).cast("bigint")


def compare_rankings(rows: DataFrame, keys: list[str], key: str = "id", left: str = "a", right: str = "b", k: str = "k") -> DataFrame:
    """Spearman correlation, exact and tie-inclusive top-k sets and their overlap, per ``keys``.

    Both sides are ranked in one distributed sort over (keys, side, value, id); a tied value's
    positions are contiguous, so its average rank is the middle of its first and last position.
    Null values share the last places of their side; null keys are a group of their own.
    A constant side has no correlation. ``k`` is a column, constant within ``keys``.
    """
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).cast("double").alias("v")) for n, c in (("l", left), ("r", right))])
    long = rows.select(*keys, F.col(key).alias("item"), F.col(k).alias("k"), F.explode(sides).alias("s")).select(*keys, "item", "k", "s.side", "s.v")
    marked = tied_positions(long, [*keys, "side"], "v", [F.col("item")]).withColumnsRenamed({"pos_first": "lo", "pos_last": "hi"})
    on = lambda side, value: F.max(F.when(F.col("side") == side, value))
    fields = {"mid": (F.col("lo") + F.col("hi")) / 2, "ex": F.col("pos") <= F.col("k"), "inc": F.col("lo") <= F.col("k"), "v": F.col("v")}
    wide = marked.groupBy(*keys, "item").agg(F.max("k").alias("k"), *[on(s, e).alias(f"{s}_{n}") for s in "lr" for n, e in fields.items()])
    both = lambda n: F.count_if(F.col(f"l_{n}") & F.col(f"r_{n}"))
    spread = F.sqrt(F.var_pop("l_mid") * F.var_pop("r_mid"))
    aggs = [F.count("*").alias("n"), F.max("k").alias("k"), F.try_divide(F.covar_pop("l_mid", "r_mid"), spread).alias("spearman"), both("ex").alias("exact_overlap"),
            both("inc").alias("inclusive_overlap"), F.count_if(F.col("l_inc") | F.col("r_inc")).alias("_union"),
            F.min(F.when(F.col("l_inc"), F.col("l_v"))).alias("left_cutoff"), F.min(F.when(F.col("r_inc"), F.col("r_v"))).alias("right_cutoff"),
            F.count_if("l_inc").alias("left_inclusive"), F.count_if("r_inc").alias("right_inclusive")]
    result = wide.groupBy(*keys).agg(*aggs) if keys else wide.agg(*aggs)
    return result.withColumn("inclusive_jaccard", F.try_divide(F.col("inclusive_overlap").cast("double"), F.col("_union"))).drop("_union")


def cell_rollup(panel: DataFrame, metrics: list[str]) -> DataFrame:
    """Per cell: members, mean, min and max of the fine value, and its metrics.

    ``unanimous`` is false where members of a cell disagree on a metric.
    """
    same = F.lit(True)
    for m in metrics:
        same = same & F.min(m).eqNullSafe(F.max(m)) & (F.count(m).isin(0) | (F.count(m) == F.count("*")))
    return panel.groupBy("cell").agg(
        F.count("*").alias("members"), F.avg("fine").alias("fine_mean"), F.min("fine").alias("fine_min"), F.max("fine").alias("fine_max"),
        *[F.min(m).alias(m) for m in metrics], same.alias("unanimous"))


def variance_partition(rows: DataFrame, keys: list[str], value: str = "fine", cell: str = "cell", equal_cells: bool = False) -> DataFrame:
    """Within, between and total population variance; weights are members or one per cell."""
    weight = F.lit(1.0) if equal_cells else F.col("n").cast("double")
    cells = rows.groupBy(*keys, cell).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).withColumn("w", weight)
    sums = [F.sum("w").alias("_w"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("_g")]
    if keys:
        centred = cells.join(cells.groupBy(*keys).agg(*sums), keys)
    else:
        grand = cells.agg(*sums).select(F.struct("_w", "_g").alias("s"))
        centred = cells.withColumn("_s", grand.scalar()).withColumns({"_w": F.col("_s._w"), "_g": F.col("_s._g")})
    within = F.sum(F.col("w") / F.col("_w") * F.col("v"))
    between = F.sum(F.col("w") / F.col("_w") * (F.col("m") - F.col("_g")) * (F.col("m") - F.col("_g")))
    grouped = centred.groupBy(*keys) if keys else centred.groupBy()
    parts = grouped.agg(within.alias("within"), between.alias("between"))
    return parts.withColumn("total", F.col("within") + F.col("between")).withColumn("within_fraction", F.try_divide("within", "total"))


def threshold_sweep(rows: DataFrame, left: str, right: str, key: str = "id") -> DataFrame:
    """The comparison at each selection share."""
    n = rows.agg(F.count("*")).scalar()
    exploded = rows.withColumn("percentage", F.explode(F.array(*[F.lit(p) for p in SELECTION_PERCENT]))).withColumn("_n", n)
    return compare_rankings(exploded.withColumn("k", selection_k(F.col("_n"), F.col("percentage"))), ["percentage"], key, left, right)


def rounding_sweep(cells: DataFrame, key: str = "cell") -> DataFrame:
    """Coarsen cell metrics to fewer decimals: comparisons and distinct values per scenario."""
    n = cells.agg(F.count("*")).scalar()
    digits = F.explode(F.array(*[F.struct(F.lit(d).alias("digits"), F.lit(10.0**d).alias("scale")) for d in DECIMALS])).alias("d")
    rows = cells.select("*", digits).withColumns({
        "digits": F.col("d.digits"), "reference_r": F.rint(F.col("reference") * F.col("d.scale")) / F.col("d.scale"),
        "seasonal_r": F.rint(F.col("seasonal") * F.col("d.scale")) / F.col("d.scale"), "_n": n})
    distinct = rows.groupBy("digits").agg(F.countDistinct("reference_r").alias("reference_distinct"), F.countDistinct("seasonal_r").alias("seasonal_distinct"))
    pairs = F.explode(F.array(F.struct(F.lit("fine_vs_seasonal").alias("pair"), F.col("fine_mean").alias("a"), F.col("seasonal_r").alias("b")),
                              F.struct(F.lit("reference_vs_seasonal").alias("pair"), F.col("reference_r").alias("a"), F.col("seasonal_r").alias("b")))).alias("p")
    long = rows.select(key, "digits", selection_k(F.col("_n"), 25).alias("k"), pairs).select(key, "digits", "k", "p.pair", "p.a", "p.b")
    return compare_rankings(long, ["digits", "pair"], key).join(distinct, "digits")


def coverage_sweep(panel: DataFrame) -> DataFrame:
    """Require 1, 2, 3 members per cell: what is kept, its variance split and its comparisons.

    The thresholds come first, so a scenario that keeps nothing still has a row.
    """
    cells = panel.groupBy("cell").agg(F.count("*").alias("members"), F.avg("fine").alias("fine_mean"), F.min("reference").alias("reference"), F.min("seasonal").alias("seasonal"))
    thresholds = F.array(*[F.lit(m) for m in MINIMUM_MEMBERS])
    scenarios = cells.withColumn("minimum_members", F.explode(thresholds)).withColumn("kept", F.col("members") >= F.col("minimum_members"))
    counts = scenarios.groupBy("minimum_members").agg(
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("members"))), F.lit(0)).alias("sites"), F.count_if("kept").alias("cells"),
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col("members"))), F.lit(0)).alias("excluded_sites"), F.count_if(~F.col("kept")).alias("excluded_cells"))
    kept = scenarios.where("kept").join(F.broadcast(counts.select("minimum_members", F.col("cells").alias("_n"))), "minimum_members")
    pairs = F.explode(F.array(F.struct(F.lit("fine").alias("pair"), F.col("fine_mean").alias("a"), F.col("seasonal").alias("b")),
                              F.struct(F.lit("reference").alias("pair"), F.col("reference").alias("a"), F.col("seasonal").alias("b")))).alias("p")
    long = kept.select("minimum_members", "cell", selection_k(F.col("_n"), 25).alias("k"), pairs).select("minimum_members", "cell", "k", "p.pair", "p.a", "p.b")
    compared = compare_rankings(long, ["minimum_members", "pair"], "cell")
    wide = compared.groupBy("minimum_members").agg(
        F.max("k").alias("k"), *[F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{p}_{c}") for p in ("fine", "reference") for c in ("spearman", "exact_overlap", "inclusive_jaccard")])
    members = panel.select("cell", "fine").join(scenarios.where("kept").select("cell", "minimum_members"), "cell")
    equal = variance_partition(members, ["minimum_members"], equal_cells=True).select("minimum_members", F.col("within_fraction").alias("equal_cell_within"))
    weighted = variance_partition(members, ["minimum_members"]).select("minimum_members", F.col("within_fraction").alias("weighted_within"))
    result = counts
    for part in (wide, equal, weighted):
        result = result.join(part, "minimum_members", "left")
    return result


def leave_one_group_out(panel: DataFrame, group: str = "district") -> DataFrame:
    """Compare cell means with the seasonal metric after omitting each group in turn.

    Sites collapse to (cell, group) sums first. A cell without the omitted group keeps its total,
    so only cell sums, not sites, are repeated per group. Groups are numbered, so a repeated row
    carries a number and no list; any number of groups is taken, a null group included.
    """
    parts = panel.groupBy("cell", group).agg(F.count("*").alias("n"), F.sum("fine").alias("s"), F.min("seasonal").alias("seasonal"))
    cells = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("seasonal").alias("seasonal"))
    numbers = materialise(ordinal(parts.select(group).distinct(), [], [F.col(group)], "number"), "groups")
    last = numbers.agg(F.coalesce(F.max("number"), F.lit(0)).cast("bigint")).scalar()
    omitted = cells.withColumn("_last", last).where("_last > 0").withColumn("number", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_last")))).drop("_last")
    named = parts.join(numbers.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    own = named.select("cell", "number", F.col("n").alias("n0"), F.col("s").alias("s0"))
    left = omitted.join(own, ["cell", "number"], "left").withColumns({
        "n": F.col("n") - F.coalesce("n0", F.lit(0)), "s": F.col("s") - F.coalesce("s0", F.lit(0.0))}).where("n > 0")
    sizes = left.groupBy("number").agg(F.count("*").alias("_c"), F.sum("n").alias("sites"))
    rows = left.join(sizes, "number").select("number", "cell", (F.col("s") / F.col("n")).alias("a"), F.col("seasonal").alias("b"), selection_k(F.col("_c"), 25).alias("k"))
    compared = compare_rankings(rows, ["number"], "cell").join(sizes.select("number", "sites"), "number")
    return compared.join(numbers.withColumnRenamed(group, "omitted"), "number").drop("number")


def association(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman between two columns, distinct values and row count (one row)."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    row = df.agg(F.count("*").alias("n"), rounded(F.try_divide(F.covar_pop(x, y), spread), 9).alias("pearson"), F.countDistinct(x).alias("distinct_x"), F.countDistinct(y).alias("distinct_y"))
    ranks = compare_rankings(df.select("id", F.col(x).alias("a"), F.col(y).alias("b"), F.lit(1).alias("k")), [])
    return row.withColumn("spearman", ranks.select(rounded("spearman", 9)).scalar())
