"""Scores, weighted rankings and sample summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.functions.numbers import min_max, rounded, weight_share
from terrascreen.operators.ordering import exact_quantiles, tied_positions, top_k

# Weights of the three scenarios (heat, proximity), the size of the compared top
# set and the overlap below which a change counts as material.
SCENARIOS = {"heat_only": (100.0, 0.0), "balanced": (60.0, 40.0), "proximity_only": (0.0, 100.0)}
TOP, MATERIAL_OVERLAP = 10, 5


def extremes(df: DataFrame, *columns: str) -> Column:
    """One struct of min and max per column, as a scalar subquery."""
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return df.agg(F.struct(*parts).alias("e")).scalar()


def minmax_score(rows: DataFrame, heat: str = "heat_pixel", distance: str = "distance_m") -> DataFrame:
    """Adds ``heat_score`` and ``proximity_score`` (0..100, 3 decimals; a flat range scores 50)."""
    marked = rows.withColumn("_e", extremes(rows, heat, distance))
    e = lambda n: F.col(f"_e.{n}")
    return marked.withColumns({
        "heat_score": rounded(min_max(F.col(heat), e(f"{heat}_lo"), e(f"{heat}_hi")), 3),
        "proximity_score": rounded(100 - min_max(F.col(distance), e(f"{distance}_lo"), e(f"{distance}_hi")), 3)}).drop("_e")


def signal(heat_weight: Column, proximity_weight: Column) -> Column:
    a, b = weight_share(heat_weight, proximity_weight)
    return rounded(F.col("heat_score") * a + F.col("proximity_score") * b, 3)


def ranked_screen(scored: DataFrame, heat: float = 60.0, proximity: float = 40.0) -> DataFrame:
    """Adds the weighted ``signal``; order by it descending, then id."""
    return scored.withColumn("signal", signal(F.lit(float(heat)), F.lit(float(proximity))))


def weight_scenarios(scored: DataFrame, scenarios: dict[str, tuple[float, float]] = SCENARIOS) -> DataFrame:
    """Per scenario: its top ten.

    The fixed scenario list is exploded on the rows, and the rank limit prunes inside each task.
    """
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(h).alias("h"), F.lit(p).alias("p")) for n, (h, p) in scenarios.items()])
    rows = scored.withColumn("s", F.explode(table)).withColumns({"scenario": F.col("s.scenario"), "signal": signal(F.col("s.h"), F.col("s.p"))}).drop("s")
    return top_k(rows, ["scenario"], [F.col("signal").desc(), F.col("id")], TOP)


def scenario_overlaps(tops: DataFrame, base: str = "balanced") -> DataFrame:
    """Overlap of each scenario's top set with the base, and whether the change is material."""
    reference = tops.where(F.col("scenario") == base).select("id").withColumn("_hit", F.lit(1))
    joined = tops.join(F.broadcast(reference), "id", "left")  # at most TOP rows
    return joined.groupBy("scenario").agg(F.count("_hit").alias("overlap")).withColumn("material_change", F.col("overlap") < MATERIAL_OVERLAP)


def top_k_inclusive(df: DataFrame, value: str, k: int, key: str = "id") -> DataFrame:
    """Rows at or above the k-th value, with the cutoff."""
    best = df.orderBy(F.col(value).desc(), F.col(key)).limit(k)
    cutoff = best.agg(F.min(value)).scalar()
    return df.withColumn("cutoff", cutoff).where(F.col(value) >= F.col("cutoff"))


def midranks(df: DataFrame, keys: list[str], value: str, name: str = "midrank") -> DataFrame:
    """Adds the descending average rank of ``value`` within ``keys``; null values tie at the end."""
    ranked = tied_positions(df, keys, value, name="_p")
    return ranked.withColumn(name, (F.col("_p_first") + F.col("_p_last")) / 2).drop("_p", "_p_first", "_p_last")


def quadrant(scored: DataFrame) -> DataFrame:
    """Adds ``high_high``: both scores at or above their own third quartile (linear rule)."""
    sides = F.explode(F.array(F.struct(F.lit("h").alias("k"), F.col("heat_score").alias("v")), F.struct(F.lit("p").alias("k"), F.col("proximity_score").alias("v"))))
    long = scored.select(sides.alias("s")).select("s.k", "s.v")
    cuts = exact_quantiles(long, ["k"], "v", {"q": 0.75}, bounded=True)
    pair = cuts.agg(F.struct(F.max(F.when(F.col("k") == "h", F.col("q"))).alias("h"), F.max(F.when(F.col("k") == "p", F.col("q"))).alias("p")).alias("c"))
    marked = scored.withColumn("_c", pair.scalar())
    return marked.withColumn("high_high", (F.col("heat_score") >= F.col("_c.h")) & (F.col("proximity_score") >= F.col("_c.p"))).drop("_c")


def group_context(scored: DataFrame) -> DataFrame:
    """Per district: rows, mean heat, exact median distance, rows in the high-high quadrant."""
    district = F.when(F.trim(F.coalesce("district", F.lit(""))) == "", "Unknown").otherwise(F.col("district"))
    rows = quadrant(scored).withColumn("district", district)
    medians = exact_quantiles(rows, ["district"], "distance_m", {"median_distance": 0.5})
    counts = rows.groupBy("district").agg(F.count("*").alias("points"), F.avg("heat_pixel").alias("mean_heat"), F.count_if("high_high").alias("high_high"))
    return counts.join(medians, "district")


def sample_summary(scored: DataFrame, register_total: Column) -> DataFrame:
    """One row: extremes and medians of heat and distance, share of the register, usable heat."""
    sides = F.explode(F.array(F.struct(F.lit("h").alias("k"), F.col("heat_pixel").cast("double").alias("v")), F.struct(F.lit("d").alias("k"), F.col("distance_m").alias("v"))))
    long = scored.select(sides.alias("s")).select("s.k", "s.v")
    medians = exact_quantiles(long, ["k"], "v", {"m": 0.5})
    pair = medians.agg(F.struct(F.max(F.when(F.col("k") == "h", F.col("m"))).alias("h"), F.max(F.when(F.col("k") == "d", F.col("m"))).alias("d")).alias("c"))
    row = scored.agg(
        F.count("*").alias("points"), F.min("heat_pixel").alias("heat_min"), F.max("heat_pixel").alias("heat_max"),
        F.count_if(F.col("heat_pixel") != 0).alias("heat_usable"), rounded(F.min("distance_m"), 1).alias("distance_min"), rounded(F.max("distance_m"), 1).alias("distance_max"))
    row = row.withColumns({"_c": pair.scalar(), "_t": register_total})
    return row.select("points", "heat_min", "heat_max", "heat_usable", "distance_min", "distance_max", rounded(F.col("_c.h"), 1).alias("heat_median"),
                      rounded(F.col("_c.d"), 1).alias("distance_median"), rounded(100.0 * F.col("points") / F.greatest(F.col("_t"), F.lit(1)), 2).alias("share_of_register"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Non-null rows per field as (field, present)."""
    counts = df.agg(*[F.count(f).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields])).alias("p")
    return counts.select(pairs).select("p.field", "p.present")


def mobility_alternatives(sites: DataFrame, daily: DataFrame) -> DataFrame:
    """Top-ten overlap of flow-based rankings: per day against the whole-window ranking.

    ``sites`` has id, station, heat_score; ``daily`` has station, day, flow, n. Inside a station
    and day the flow is one value, so its ten best sites by heat contain every site that can
    reach the top ten of that day.
    """
    used = daily.join(sites.select("station").distinct(), "station", "left_semi")
    weekly = used.groupBy("station").agg((F.sum(F.col("flow") * F.col("n")) / F.sum("n")).alias("flow")).withColumn("variant", F.lit("window"))
    flows = used.select("station", "flow", F.col("day").cast("string").alias("variant")).unionByName(weekly)
    spans = flows.groupBy("variant").agg(F.min("flow").alias("low"), F.max("flow").alias("high"))
    low, high = F.col("low"), F.col("high")
    scaled = flows.join(spans, "variant").withColumn("scaled", F.when(high == low, F.lit(0.0)).otherwise((F.col("flow") - low) / (high - low)))
    best = top_k(sites, ["station"], [F.col("heat_score").desc(), F.col("id")], TOP).drop("rank")
    rows = best.join(scaled, "station").withColumn("score", F.lit(0.6) * F.col("heat_score") + F.lit(0.4) * F.col("scaled"))
    tops = top_k(rows, ["variant"], [F.col("score").desc(), F.col("id")], TOP)
    reference = tops.where("variant = 'window'").select("id").withColumn("_hit", F.lit(1))
    return tops.join(F.broadcast(reference), "id", "left").groupBy("variant").agg(F.count("_hit").alias("overlap"))


def flow_rankings(sites: DataFrame, flows: DataFrame) -> DataFrame:
    """Top tens by flow alone and by 60/40 heat and scaled flow, against the balanced top ten.

    ``sites`` has id, station, heat_score, signal; ``flows`` has station, flow (measured only).
    """
    known = sites.join(flows, "station")
    bounds = extremes(known, "flow")
    rows = known.withColumn("_e", bounds)
    scaled = F.when(F.col("_e.flow_hi") == F.col("_e.flow_lo"), F.lit(0.0)).otherwise((F.col("flow") - F.col("_e.flow_lo")) / (F.col("_e.flow_hi") - F.col("_e.flow_lo")))
    scores = F.array(F.struct(F.lit("flow_only").alias("variant"), F.col("flow").alias("score")),
                     F.struct(F.lit("weighted").alias("variant"), (F.lit(0.6) * F.col("heat_score") + F.lit(0.4) * scaled).alias("score")))
    ranked = rows.select("id", F.explode(scores).alias("s")).select("id", "s.variant", "s.score")
    tops = top_k(ranked, ["variant"], [F.col("score").desc(), F.col("id")], TOP)
    balanced = sites.orderBy(F.col("signal").desc(), "id").limit(TOP).select("id").withColumn("_hit", F.lit(1))
    return tops.join(F.broadcast(balanced), "id", "left").groupBy("variant").agg(F.count("_hit").alias("overlap"))
