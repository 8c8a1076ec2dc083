"""JSON snapshots and landed API responses as tables; schemas are explicit and parsing fails fast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascreen.functions.geo import in_envelope
from terrascreen.functions.text import first_present, parse_slash_date

# Record layouts of the snapshots.
SITE_RECORD = "id STRING, street STRING, district STRING, latitude DOUBLE, longitude DOUBLE, species STRING, source STRING"
STATION_RECORD = "id STRING, street STRING, active BOOLEAN, longitude DOUBLE, latitude DOUBLE"
SLOT_RECORD = "count_date STRING, time_gap INT, count DOUBLE, average_speed DOUBLE"
FEATURES = "features ARRAY<STRUCT<properties: STRUCT<device_name: STRING, road_en: STRING, road_fr: STRING, active: BOOLEAN>, geometry: STRUCT<coordinates: ARRAY<DOUBLE>>>>"
REGISTER = ("id STRING, address_fr STRING, adress_nl STRING, district_fr STRING, district_nl STRING, species STRING, source_fr STRING, source_nl STRING, "
            "geo_point_2d STRUCT<lat: DOUBLE, lon: DOUBLE>")


def envelope_schema(record: str, scalars: str = "") -> str:
    """DDL of an envelope: provenance scalars plus a ``records`` array."""
    inside = ", ".join(part.strip().replace(" ", ": ", 1) for part in record.split(","))
    return ", ".join(p for p in (scalars, f"records ARRAY<STRUCT<{inside}>>") if p)


def read_snapshot(spark: SparkSession, paths: str | Sequence[str], record: str, scalars: str = "") -> DataFrame:
    """Records of envelope files in file order: scalars, ``pos`` and the record fields.

    Several files are read as one table, each parsed by its own task.
    """
    raw = spark.read.schema(envelope_schema(record, scalars)).option("multiLine", True).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))
    return expand_records(raw)


def parse_snapshot(rows: DataFrame, body: str, record: str, scalars: str = "") -> DataFrame:
    """The same for envelopes that already sit in a text column."""
    parsed = F.from_json(F.col(body), envelope_schema(record, scalars), {"mode": "FAILFAST"})
    keep = [c for c in rows.columns if c != body]
    return expand_records(rows.select(*keep, parsed.alias("_p")).select(*keep, "_p.*"))


def expand_records(envelopes: DataFrame) -> DataFrame:
    keep = [c for c in envelopes.columns if c != "records"]
    return envelopes.select(*keep, F.posexplode("records").alias("pos", "_r")).select(*keep, "pos", "_r.*")


def slot_history(records: DataFrame) -> DataFrame:
    """Long slot table from history records; dates must parse and lie in the declared window."""
    day = parse_slash_date(F.col("count_date"))
    rows = records.select("feature", day.alias("obs_day"), F.col("time_gap").alias("slot"), F.col("count").alias("cnt"), F.col("average_speed").alias("speed"),
                          parse_slash_date(F.col("start_date")).alias("_lo"), parse_slash_date(F.col("end_date")).alias("_hi"))
    inside = F.col("obs_day").between(F.col("_lo"), F.col("_hi"))
    problem = F.raise_error(F.concat(F.lit("record outside the declared window: "), F.col("feature"))).cast("date")
    return rows.withColumn("obs_day", F.when(inside, F.col("obs_day")).otherwise(problem)).drop("_lo", "_hi")


def read_slot_history(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One long slot table from any number of per-feature history files."""
    return slot_history(read_snapshot(spark, paths, SLOT_RECORD, "feature STRING, start_date STRING, end_date STRING"))


def flatten_features(rows: DataFrame, body: str = "body") -> DataFrame:
    """Station rows of feature collections, with ``problem`` for unusable geometry."""
    parsed = rows.select(F.explode(F.from_json(F.col(body), FEATURES, {"mode": "FAILFAST"})["features"]).alias("f"))
    lon, lat = F.get("f.geometry.coordinates", F.lit(0)), F.get("f.geometry.coordinates", F.lit(1))
    problem = F.when(lon.isNull() | lat.isNull(), "invalid_geometry").when(~in_envelope(lat, lon), "outside_envelope")
    return parsed.select(F.col("f.properties.device_name").alias("id"), first_present(F.col("f.properties.road_en"), F.col("f.properties.road_fr")).alias("street"),
                         F.col("f.properties.active").alias("active"), lon.alias("longitude"), lat.alias("latitude"), problem.alias("problem"))


def flatten_register(rows: DataFrame, body: str = "body") -> DataFrame:
    """Site rows of register records; French text first, Dutch where it is blank."""
    r = F.from_json(F.col(body), REGISTER, {"mode": "FAILFAST"})
    parsed = rows.select(r.alias("r"))
    c = lambda n: F.col(f"r.{n}")
    return parsed.select(c("id").alias("id"), first_present(c("address_fr"), c("adress_nl")).alias("street"), first_present(c("district_fr"), c("district_nl")).alias("district"),
                         c("geo_point_2d.lat").alias("latitude"), c("geo_point_2d.lon").alias("longitude"), c("species").alias("species"), first_present(c("source_fr"), c("source_nl")).alias("source"))


def page_set_check(pages: DataFrame) -> DataFrame:
    """Landed pages per source: one declared total everywhere, and as many rows as it says."""
    sets = pages.groupBy("source").agg(F.min("total_count").alias("declared"), (F.min("total_count") != F.max("total_count")).alias("_moved"), F.sum(F.size("results")).alias("n_rows"))
    problem = F.when(F.col("_moved"), "total_changed").when(F.col("n_rows") != F.col("declared"), "row_count")
    return sets.select("source", "declared", "n_rows", problem.alias("problem"))


def bbox_extract(features: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Features whose envelope meets a window: plain range predicates that reach the scan."""
    x0, y0, x1, y1 = bounds
    return features.where((F.col("x2") >= x0) & (F.col("x1") <= x1) & (F.col("y2") >= y0) & (F.col("y1") <= y1))


def meets_window(bounds: tuple[float, float, float, float]) -> Column:
    """The same test from the other side: neither box lies beyond the other."""
    x0, y0, x1, y1 = bounds
    return ~((F.col("x2") < x0) | (F.col("x1") > x1) | (F.col("y2") < y0) | (F.col("y1") > y1))
