"""Ranking files and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascreen.functions.text import spreadsheet_safe
from terrascreen.operators.ordering import ordinal


def write_ranking_csv(ranked: DataFrame, path: str, order: list, columns: list[str]) -> None:
    """Rows in rank order as CSV with formula-safe text cells and doubled quotes.

    The rank is a distributed ordinal, and files are range-partitioned by it.
    """
    rows = ordinal(ranked, [], order, "rank").select("rank", *columns)
    text = {f.name for f in rows.schema.fields if f.dataType.typeName() == "string"}
    safe = rows.select(*[spreadsheet_safe(F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns])
    safe.repartitionByRange("rank").sortWithinPartitions("rank").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_ranking_csv(spark: SparkSession, path: str, schema: str, top: int = 10) -> DataFrame:
    """First ``top`` rows of a ranked CSV."""
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    return rows.where(F.col("rank") <= top)


def ranking_problems(top: DataFrame, known: DataFrame, expected: int = 10) -> DataFrame:
    """Top rows that repeat an id or name an unknown one, and a wrong row count."""
    repeated = top.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").alias("key"))
    unknown = top.join(known.select("id"), "id", "left_anti").select(F.lit("unknown_id").alias("rule"), F.col("id").alias("key"))
    count = top.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("row_count").alias("rule"), F.col("n").cast("string").alias("key"))
    return repeated.unionByName(unknown).unionByName(count)


def write_report_tables(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """One JSON dataset per report table."""
    paths = {name: f"{base}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.option("ignoreNullFields", False).json(paths[name])
    return paths


def read_report_tables(spark: SparkSession, base: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a report as written; a value that does not fit its column's type stops the reading."""
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{base}/{name}") for name, schema in schemas.items()}


def report_problems(tables: dict[str, DataFrame], read: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table that were lost or came up between writing and reading (``rule, key``), repeats included."""
    found = None
    for name, table in tables.items():
        digest = lambda df: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
        counts = digest(table).join(digest(read[name]).withColumnRenamed("n", "m"), "row", "full").where(~F.col("n").eqNullSafe(F.col("m")))
        part = counts.select(F.concat(F.lit(f"{name}_"), F.when(F.coalesce("n", F.lit(0)) > F.coalesce("m", F.lit(0)), "lost").otherwise("added")).alias("rule"), F.col("row").alias("key"))
        found = part if found is None else found.unionByName(part)
    return found
