"""Data-quality rules as violation tables ``(rule, key)``; an empty table means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.functions import geo, text
from terrascreen.operators.series import violations

__all__ = ["violations"]


def enforce(problems: DataFrame, sample: int = 20) -> None:
    """Fail when a violation table is not empty, naming the first few rows."""
    found = problems.limit(sample).collect()
    if found:
        raise ValueError("; ".join(f"{row['rule']}: {row['key']}" for row in found))


def _named(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def dq_keys(rows: DataFrame, expected: DataFrame, declared_total: Column | None = None, key: str = "id", row_count: Column | None = None) -> DataFrame:
    """Empty and duplicate ids, ids missing from or unknown to the expected set, total below rows, and a number of rows other than expected."""
    used = F.coalesce(F.col(key).cast("string"), F.lit(""))
    counted = rows.groupBy(used.alias("_k")).agg(F.count("*").alias("n"))
    wanted = expected.select(F.col(key).cast("string").alias("_k")).distinct()
    parts = [
        _named(counted.where("_k = ''"), "empty_id", F.col("n")), _named(counted.where("n > 1 AND _k <> ''"), "duplicate_id", F.col("_k")),
        _named(wanted.join(counted, "_k", "left_anti"), "missing_id", F.col("_k")), _named(counted.where("_k <> ''").join(wanted, "_k", "left_anti"), "unknown_id", F.col("_k"))]
    if declared_total is not None:
        total = rows.agg(F.count("*").alias("n")).withColumn("_t", declared_total)
        parts.append(_named(total.where(F.coalesce(F.col("_t") < F.col("n"), F.lit(True))), "declared_total", F.col("_t")))
    if row_count is not None:
        size = rows.agg(F.count("*").alias("n")).withColumn("_c", row_count)
        parts.append(_named(size.where(~F.col("n").eqNullSafe(F.col("_c"))), "row_count", F.col("n")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def compare_tables(stored: DataFrame, fresh: DataFrame, keys: list[str], measures: dict[str, float | None]) -> DataFrame:
    """Stored against recomputed rows: rows on one side only, and every measure that differs.

    A tolerance of None asks for null-safe equality; a number allows that absolute difference,
    with null equal only to null.
    """
    a = stored.select(*keys, *[F.col(m).alias(f"a_{m}") for m in measures]).withColumn("_a", F.lit(True))
    b = fresh.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures]).withColumn("_b", F.lit(True))
    joined = a.join(b, keys, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checks = [("not_stored", F.col("_a").isNull()), ("not_recomputed", F.col("_b").isNull())]
    for name, tolerance in measures.items():
        x, y = F.col(f"a_{name}"), F.col(f"b_{name}")
        same = x.eqNullSafe(y) if tolerance is None else (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        checks.append((name, both & ~same))
    return violations(joined, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), checks)


def dq_copied_fields(rows: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Copied columns that differ from the source row of the same key."""
    origin = source.select(key, *[F.col(f).alias(f"s_{f}") for f in fields])
    return violations(rows.join(origin, key), F.col(key), [(f, ~F.col(f).eqNullSafe(F.col(f"s_{f}"))) for f in fields])


def dq_ranges(rows: DataFrame, key: str, bounds: dict[str, tuple[float, float]], integers: list[str] = ()) -> DataFrame:
    """Values outside inclusive bounds (null counts as outside) and values that are not whole."""
    checks = [(f"{c}_range", ~F.col(c).between(lo, hi)) for c, (lo, hi) in bounds.items()]
    checks += [(f"{c}_integer", F.col(c) != F.rint(F.col(c).cast("double"))) for c in integers]
    return violations(rows, F.col(key), checks)


def dq_orderings(rows: DataFrame, key: str, pairs: list[tuple[str, str, float]]) -> DataFrame:
    """Pairs ``low <= high + slack`` that do not hold."""
    return violations(rows, F.col(key), [(f"{a}_above_{b}", F.col(a) > F.col(b) + slack) for a, b, slack in pairs])


def dq_percentile_rank(rows: DataFrame, key: str, percentile: str, rank: str, n: Column) -> DataFrame:
    """A percentile that is not the one its rank implies."""
    implied = 100.0 * (F.col(rank) - 1) / n
    return violations(rows, F.col(key), [("percentile_rank", F.abs(F.col(percentile) - implied) > 0.05 + 1e-9)])


def dq_pixels(rows: DataFrame, key: str = "id") -> DataFrame:
    """Stored raster columns and rows that differ from the projected coordinates."""
    placed = geo.with_lambert72(rows, x="_x", y="_y")
    col, row = geo.pixel_index(F.col("_x"), F.col("_y"))
    return violations(placed, F.col(key), [("pixel_column", F.col("heat_column") != col), ("pixel_row", F.col("heat_row") != row)])


def dq_incidents(stored: DataFrame, fresh: DataFrame, source: DataFrame, record_count: Column) -> DataFrame:
    """Stored radius counts against recomputed ones, inner and flagged bounds, and row totals.

    Source rows without usable coordinates are skipped and must reconcile with the total.
    """
    names = ["within_inner", "flagged_inner", "within_outer", "flagged_outer"]
    counts = compare_tables(stored, fresh, ["id"], {n: None for n in names})
    order = dq_orderings(stored, "id", [("within_inner", "within_outer", 0), ("flagged_inner", "within_inner", 0), ("flagged_outer", "within_outer", 0), ("flagged_inner", "flagged_outer", 0)])
    usable = text_free(F.col("latitude")) & text_free(F.col("longitude"))
    totals = source.agg(F.count_if(usable).alias("used"), F.count("*").alias("n")).withColumn("_c", record_count)
    short = _named(totals.where(~F.col("_c").eqNullSafe(F.col("used"))), "record_count", F.col("_c"))
    return counts.unionByName(order).unionByName(short)


def text_free(value: Column) -> Column:
    """A coordinate that is present and finite."""
    number = value.cast("double")
    return F.coalesce(value.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def dq_cells(sites: DataFrame, records: DataFrame, cells: DataFrame, metrics: list[str]) -> DataFrame:
    """Site records against snapping and their cell; cells must exactly cover the sites."""
    snapped = sites.select("id", geo.grid_key(F.col("latitude"), F.col("longitude")).alias("_snap"))
    table = cells.select(F.col("grid_key").alias("_g"), *[F.col(m).alias(f"c_{m}") for m in metrics])
    joined = records.join(snapped, "id").join(table, F.col("grid_key") == F.col("_g"), "left")
    checks = [("wrong_cell", ~F.col("grid_key").eqNullSafe(F.col("_snap"))), ("unknown_cell", F.col("_g").isNull())]
    checks += [(m, F.col("_g").isNotNull() & ~F.col(m).eqNullSafe(F.col(f"c_{m}"))) for m in metrics]
    rows = violations(joined, F.col("id"), checks)
    unused = cells.select("grid_key").distinct().join(records.select("grid_key"), "grid_key", "left_anti")
    return rows.unionByName(_named(unused, "unused_cell", F.col("grid_key")))


def dq_cube(records: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """Stored cube cells: centre within half a step of the projected site, one centre per cell."""
    placed = geo.with_laea(records, x="_x", y="_y")
    half = step / 2 + 1e-6
    rows = violations(placed, F.col("id"), [("cell_x", F.abs(F.col("_x") - F.col("cell_x")) > half), ("cell_y", F.abs(F.col("_y") - F.col("cell_y")) > half)])
    centres = records.groupBy("col", "row").agg((F.min("cell_x") != F.max("cell_x")).alias("mx"), (F.min("cell_y") != F.max("cell_y")).alias("my"))
    split = _named(centres.where("mx OR my"), "cell_centre", F.concat_ws(":", F.col("col").cast("string"), F.col("row").cast("string")))
    return rows.unionByName(split)


def field_values(df: DataFrame, dataset: str, fields: list[str]) -> DataFrame:
    """Columns as rows ``dataset, field, value`` for inventory and contract checks."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return df.select(F.col(dataset).alias("dataset"), pairs).select("dataset", "p.field", "p.value")


def dq_contract(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected ``dataset, field, value`` rows that the actual table lacks or contradicts."""
    found = actual.select("dataset", "field", F.col("value").alias("_v"), F.lit(True).alias("_hit"))
    joined = expected.join(found, ["dataset", "field"], "left")
    rule = F.when(F.col("_hit").isNull(), "not_declared").when(~F.col("value").eqNullSafe(F.col("_v")), "differs")
    return joined.select(rule.alias("rule"), F.concat_ws(":", "dataset", "field").alias("key")).where(F.col("rule").isNotNull())


def dq_provenance(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Groups whose inputs carry more than one combination of provenance fields."""
    combos = rows.select(group, *fields).distinct().groupBy(group).agg(F.count("*").alias("n"))
    return _named(combos.where("n > 1"), "mixed_provenance", F.col(group))


def dq_raster_uniform(pixels: DataFrame, row_step: int = 997, col_step: int = 991, columns: int = 10_000, rows: int = 9_000) -> DataFrame:
    """A raster whose strided pixels all hold one value cannot carry spatial variation.

    Pixels outside the declared size and values that are no 8-bit number are listed as well.
    """
    place = F.concat_ws(":", F.col("col").cast("string"), F.col("row").cast("string"))
    wrong = violations(pixels.select("col", "row", "value").distinct(), place, [
        ("outside_raster", ~(F.col("col").between(0, columns - 1) & F.col("row").between(0, rows - 1))), ("value_type", ~F.col("value").between(0, 255))])
    strided = pixels.where((F.col("row") % row_step == 1) & (F.col("col") % col_step == 1))
    spread = strided.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return _named(spread.where("lo IS NULL OR lo = hi"), "uniform_raster", F.col("lo")).unionByName(wrong)


def dq_series_values(daily: DataFrame, key: str, ranges: dict[str, tuple[float, float]], low: str, high: str, units: dict[str, str] | None = None) -> DataFrame:
    """Daily rows that are missing, not finite or implausible, or whose minimum exceeds the maximum.

    A series must hold every day between its first and last, once (``missing_days``, ``repeated_days``).
    """
    checks = []
    for column, (lo, hi) in ranges.items():
        usable = text_free(F.col(column))
        checks += [(f"{column}_finite", ~usable), (f"{column}_range", usable & ~F.col(column).between(lo, hi))]
    checks.append(("minimum_above_maximum", F.coalesce(F.col(low) > F.col(high), F.lit(False))))
    for column, unit in (units or {}).items():
        checks.append((f"{column}_unit", ~F.col(f"{column}_unit").eqNullSafe(F.lit(unit))))
    calendar = daily.groupBy(F.col(key).cast("string").alias("series")).agg(
        F.count("*").alias("n"), F.countDistinct("obs_day").alias("d"), (F.datediff(F.max("obs_day"), F.min("obs_day")) + 1).alias("span"))
    gaps = violations(calendar, F.col("series"), [("missing_days", F.col("d") < F.col("span")), ("repeated_days", F.col("n") > F.col("d"))])
    return violations(daily, F.concat_ws(":", F.col(key).cast("string"), F.col("obs_day").cast("string")), checks).unionByName(gaps)


# Label classes.
LABELS = ("canopy", "not_canopy", "unknown")


def dq_protocol(files: DataFrame) -> DataFrame:
    """Label files whose protocol is not stated, or was not leaf-on and blinded."""
    return violations(files, F.col("file"), [
        ("reference_definition", text.is_blank(F.col("reference_definition"))), ("source_hierarchy", text.is_blank(F.col("source_hierarchy"))),
        ("leaf_on", ~F.coalesce("leaf_on", F.lit(False))), ("blinded", ~F.coalesce("blinded", F.lit(False)))])


def dq_labels(labels: DataFrame) -> DataFrame:
    """Label rows with an unknown class, no interpreter, an invalid date or undeclared fields."""
    return violations(labels, F.col("key"), [
        ("label", ~F.col("label").isin(*LABELS)), ("interpreter", text.is_blank(F.col("interpreter"))), ("date", ~text.is_iso_date(F.col("day_text"))),
        ("fields", F.size("unknown_fields") > 0)])


# Review fields, in the order of the worksheet.
COMMON_REQUIRED = ("review_status", "reviewer_name", "reviewer_role", "reviewed_at", "false_positive_preference", "evidence_threshold", "review_notes")
ACCEPTED_REQUIRED = ("accepted_decision_question", "accepted_spatial_unit", "accepted_mobility_measure", "accepted_heat_period")
ACCEPTED_STATUSES = ("accepted", "accepted with changes")
ALLOWED_STATUSES = ("accepted", "accepted with changes", "needs more evidence", "rejected")


def review_compile(reviews: DataFrame, evidence: DataFrame, provenance: list[str]) -> DataFrame:
    """Per proposal: pending, completed or invalid, with the failed fields.

    An all-blank review is pending. A review needs the common fields, an allowed status, an
    ISO 8601 time, four more fields when accepted, and evidence that has not changed since.
    """
    fields = [*COMMON_REQUIRED, *ACCEPTED_REQUIRED]
    current = evidence.select("proposal_id", *[F.col(p).alias(f"e_{p}") for p in provenance]).withColumn("_known", F.lit(True))
    joined = reviews.join(current, "proposal_id", "left")
    blank = {f: text.is_blank(F.col(f)) for f in fields}
    filled = F.lit(False)
    for flag in blank.values():
        filled = filled | ~flag
    status = F.trim(text.null_text(F.col("review_status")))
    accepted = status.isin(*ACCEPTED_STATUSES)
    failed = [F.when(blank[f], F.lit(f)) for f in COMMON_REQUIRED]
    failed += [F.when(accepted & blank[f], F.lit(f)) for f in ACCEPTED_REQUIRED]
    failed += [F.when(~status.isin(*ALLOWED_STATUSES) & ~blank["review_status"], F.lit("status_value")),
               F.when(~text.is_iso8601(F.trim(text.null_text(F.col("reviewed_at")))) & ~blank["reviewed_at"], F.lit("reviewed_at_value")),
               F.when(F.col("_known").isNull(), F.lit("proposal"))]
    failed += [F.when(F.col("_known").isNotNull() & (text.null_text(F.col(p)) != text.null_text(F.col(f"e_{p}"))), F.lit(f"evidence_{p}")) for p in provenance]
    problems = F.when(filled, F.array_compact(F.array(*failed))).otherwise(F.array().cast("array<string>"))
    state = F.when(~filled, "pending").when(F.size("_p") > 0, "invalid").otherwise("completed")
    return joined.withColumn("_p", problems).select("proposal_id", state.alias("state"), F.array_join("_p", ",").alias("failed"))


def compiled_reviews(reviews: DataFrame, compiled: DataFrame) -> DataFrame:
    """Records of the completed reviews."""
    return reviews.join(compiled.where("state = 'completed'").select("proposal_id"), "proposal_id", "left_semi")
