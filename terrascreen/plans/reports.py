"""Report tables as sets: built from the other queries, written, read back and held against what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.operators.ordering import materialise, top_k
from terrascreen.operators.quality import enforce
from terrascreen.plans import comparisons, joins, seasons  # noqa: F401  the queries that the tables are made of
from terrascreen.plans.registry import CHECKS, PLANS, query
from terrascreen.session import scratch_path
from terrascreen.sources import sinks

#: Table: the query it is made of, its key, its other columns.
SCREENING = {
    "sample_summary": ("sample_summary", (), ("points", "heat_min", "heat_max", "heat_median", "heat_usable", "distance_min", "distance_max", "distance_median", "share_of_register")),
    "completeness": ("field_completeness", ("field",), ("present",)),
    "district_context": ("group_context", ("district",), ("points", "mean_heat", "median_distance", "high_high")),
    "weight_sensitivity": ("weight_scenarios", ("scenario", "rank"), ("id", "signal", "overlap", "material_change")),
    "balanced_screen": ("ranked_screen", ("rank",), ("id", "distance_m", "signal")),
    "counters": ("history_station_rows", ("feature",), ("mean_all", "min_day_mean", "max_day_mean", "place")),
}
SUPPORT = {
    "metric_matrix": ("metric_matrix", ("unit", "metric"), ("n", "k", "spearman", "exact_overlap", "inclusive_overlap", "inclusive_jaccard", "left_inclusive", "right_inclusive")),
    "top_cells": ("distinct_cells_in_top", ("metric",), ("cells",)),
    "variance": ("variance_partition", ("weights",), ("within", "between", "within_fraction")),
    "leave_one_out": ("leave_one_group_out", ("omitted",), ("sites", "n", "spearman")),
    "selection_fractions": ("threshold_sweep", ("percentage",), ("n", "k", "left_inclusive", "right_inclusive", "inclusive_jaccard")),
    "coarsening": ("rounding_sweep", ("digits", "pair"), ("reference_distinct", "seasonal_distinct", "inclusive_jaccard", "spearman")),
    "coverage": ("coverage_sweep", ("minimum_members",), ("sites", "cells", "excluded_sites", "excluded_cells", "k", "equal_cell_within", "fine_spearman", "reference_spearman")),
}
_FIRST = 10


def _source(t, name: str) -> DataFrame:
    table = PLANS[name](t)
    return top_k(table, [], [F.desc("signal"), F.col("id")], _FIRST) if name == "ranked_screen" else table


def _source_sql(name: str) -> str:
    if name == "ranked_screen":
        return f"(SELECT *, row_number() OVER (ORDER BY signal DESC, id) AS rank FROM ({CHECKS[name]}) QUALIFY rank <= {_FIRST})"
    return f"({CHECKS[name]})"


def _report(t, layout: dict) -> DataFrame:
    """All cells of the tables as read back: ``table_name, key, measure`` with ``value`` (numbers) or ``word`` (text)."""
    tables = {name: materialise(_source(t, source).select(*keys, *measures), name) for name, (source, keys, measures) in layout.items()}
    base = scratch_path(t.spark, "report")
    sinks.write_report_tables(tables, base)
    read = sinks.read_report_tables(t.spark, base, {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) for name, table in tables.items()})
    enforce(sinks.report_problems(tables, read))
    rows = None
    for name, (_, keys, measures) in layout.items():
        kinds = dict(read[name].dtypes)
        cell = lambda m: F.struct(F.lit(m).alias("measure"), (F.lit(None) if kinds[m] == "string" else F.col(m)).cast("double").alias("value"), (F.col(m) if kinds[m] == "string" else F.lit(None)).cast("string").alias("word"))  # noqa: E731, B023
        part = read[name].select(F.lit(name).alias("table_name"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"), F.explode(F.array(*map(cell, measures))).alias("c")).select("table_name", "key", "c.*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


_WORDS = ("id",)


def _report_sql(layout: dict) -> str:
    parts = []
    for name, (source, keys, measures) in layout.items():
        key = "concat_ws(':', " + ", ".join(f"{k}::varchar" for k in keys) + ")" if keys else "''"
        values = ", ".join("NULL::double" if m in _WORDS else f"{m}::double" for m in measures)
        words = ", ".join(f"{m}::varchar" if m in _WORDS else "NULL::varchar" for m in measures)
        parts.append(f"SELECT '{name}' AS table_name, {key} AS key, unnest([{', '.join(repr(m) for m in measures)}]) AS measure, unnest([{values}]) AS value, unnest([{words}]) AS word FROM {_source_sql(source)}")
    return " UNION ALL ".join(parts)


@query("screening_report", _report_sql(SCREENING))
def screening_report(t):
    return _report(t, SCREENING)


@query("support_report", _report_sql(SUPPORT))
def support_report(t):
    return _report(t, SUPPORT)
