"""Domain views over the given tables, as DataFrames and as the matching SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQL_VIEWS = {
    "sites": """SELECT 'c'||lpad(cast(c_custkey AS varchar),7,'0') AS id, c_custkey AS ord,
        CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS street,
        CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_mktsegment END AS district,
        50.75 + cast((c_custkey*7919) % 2000 AS double)/10000.0 AS latitude,
        4.25 + cast((c_custkey*104729) % 2000 AS double)/10000.0 AS longitude,
        cast(1 + (c_custkey*31) % 100 AS bigint) AS heat_pixel FROM customer""",
    "stations": """SELECT 's'||lpad(cast(s_suppkey AS varchar),5,'0') AS id, s_suppkey AS ord, s_name AS street,
        50.75 + cast((s_suppkey*6101) % 2000 AS double)/10000.0 AS latitude,
        4.25 + cast((s_suppkey*3571) % 2000 AS double)/10000.0 AS longitude FROM supplier""",
    "incidents": """SELECT o_orderkey AS id, cast(year(o_orderdate) AS varchar) AS yr,
        (o_orderpriority='1-URGENT') AS flagged,
        50.75 + cast((o_orderkey*7919) % 2000 AS double)/10000.0 AS latitude,
        4.25 + cast((o_orderkey*15485) % 2000 AS double)/10000.0 AS longitude FROM orders""",
    "slots4": """SELECT event_type AS feature, cast(ts AS date) AS obs_day, cast(floor(hour(ts)*4/24.0) AS int)+1 AS slot,
        cast(count(*) AS double) AS cnt FROM events GROUP BY 1,2,3""",
    "slots24": """SELECT event_type AS feature, cast(ts AS date) AS obs_day, cast(floor(hour(ts)*24/24.0) AS int)+1 AS slot,
        cast(count(*) AS double) AS cnt FROM events GROUP BY 1,2,3""",
    "cube2": """SELECT l_suppkey % 2 AS cell, cast(l_shipdate AS date) AS obs_day, avg(l_quantity) AS val,
        avg(l_quantity) - 1 - avg(l_tax)*100 AS low, max(l_quantity) AS top FROM lineitem GROUP BY 1,2""",
    "cube5": """SELECT l_suppkey % 5 AS cell, cast(l_shipdate AS date) AS obs_day, avg(l_quantity) AS val,
        avg(l_quantity) - 1 - avg(l_tax)*100 AS low, max(l_quantity) AS top FROM lineitem GROUP BY 1,2""",
    "frame": """SELECT o_orderkey % 5 AS gid, o_orderkey // 5 AS idx, ((o_orderkey // 5) + 0.5::double)*2.0::double AS chainage,
        CASE o_orderstatus WHEN 'F' THEN 'mapped_overlap' WHEN 'P' THEN 'proximity_only'
        ELSE 'mapped_non_overlap' END AS stratum FROM orders""",
    "intervals": """SELECT l_orderkey % 1000 AS route, cast((l_partkey*37 + l_linenumber*911) % 10000 AS double)/10.0 AS a,
        cast((l_partkey*37 + l_linenumber*911) % 10000 AS double)/10.0 + l_quantity/10.0 AS b FROM lineitem""",
    "rects": """SELECT p_partkey AS poly_id, 3 + p_size % 2 AS cls, cast((p_partkey*53) % 1000 AS double) AS x1,
        cast((p_partkey*97) % 1000 AS double) AS y1, cast((p_partkey*53) % 1000 AS double) + p_size/4.0::double AS x2,
        cast((p_partkey*97) % 1000 AS double) + p_size/4.0::double AS y2 FROM part""",
    "vertices": """SELECT s_suppkey // 5 AS gid, s_suppkey % 5 + 1 AS seq,
        cast((s_suppkey*61) % 1000 AS double) AS x, cast((s_suppkey*89) % 1000 AS double) AS y FROM supplier""",
}


def rnd(expression: str, digits: int) -> str:
    """SQL for scale, round half to even, unscale."""
    return f"(round_even(({expression})*1e{digits},0)/1e{digits})"


def sql(views: str, body: str) -> str:
    """Full query text: the named views (and their inputs) as CTEs before the body."""
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in views.split()]
    body = body.strip()
    starts_select = body[:6].lower() == "select"
    if not parts:
        return body if starts_select else f"WITH {body}"
    return "WITH " + ", ".join(parts) + (" " if starts_select else ", ") + body


def haversine_sql(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return (f"(2*6371000.0*asin(sqrt(pow(sin((radians({b_lat})-radians({a_lat}))/2),2)"
            f"+cos(radians({a_lat}))*cos(radians({b_lat}))*pow(sin((radians({b_lon})-radians({a_lon}))/2),2))))")


class Views:
    """DataFrame counterparts of :data:`SQL_VIEWS`."""

    def __init__(self, tables):
        self._t = tables

    @staticmethod
    def _spread(key: str, factor: int, start: float):
        return F.lit(start) + ((F.col(key) * factor) % 2000).cast("double") / 10000.0

    @cached_property
    def sites(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._t.customer.select(
            F.concat(F.lit("c"), F.lpad(key.cast("string"), 7, "0")).alias("id"), key.alias("ord"),
            F.when(key % 9 != 0, F.col("c_name")).alias("street"),
            F.when(key % 41 != 0, F.col("c_mktsegment")).alias("district"),
            self._spread("c_custkey", 7919, 50.75).alias("latitude"),
            self._spread("c_custkey", 104729, 4.25).alias("longitude"),
            (1 + (key * 31) % 100).cast("bigint").alias("heat_pixel"))

    @cached_property
    def stations(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._t.supplier.select(
            F.concat(F.lit("s"), F.lpad(key.cast("string"), 5, "0")).alias("id"), key.alias("ord"),
            F.col("s_name").alias("street"),
            self._spread("s_suppkey", 6101, 50.75).alias("latitude"),
            self._spread("s_suppkey", 3571, 4.25).alias("longitude"))

    @cached_property
    def incidents(self) -> DataFrame:
        return self._t.orders.select(
            F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("string").alias("yr"),
            (F.col("o_orderpriority") == "1-URGENT").alias("flagged"),
            self._spread("o_orderkey", 7919, 50.75).alias("latitude"),
            self._spread("o_orderkey", 15485, 4.25).alias("longitude"))

    def slots(self, per_day: int) -> DataFrame:
        return (self._t.events
                .select(F.col("event_type").alias("feature"), F.to_date("ts").alias("obs_day"),
                        (F.floor(F.hour("ts") * per_day / 24.0).cast("int") + 1).alias("slot"))
                .groupBy("feature", "obs_day", "slot").agg(F.count("*").cast("double").alias("cnt")))

    def cube(self, cells: int) -> DataFrame:
        return (self._t.lineitem
                .groupBy((F.col("l_suppkey") % cells).alias("cell"), F.to_date("l_shipdate").alias("obs_day"))
                .agg(F.avg("l_quantity").alias("val"),
                     (F.avg("l_quantity") - 1 - F.avg("l_tax") * 100).alias("low"),
                     F.max("l_quantity").alias("top")))

    @cached_property
    def frame(self) -> DataFrame:
        key = F.col("o_orderkey")
        idx = F.floor(key / 5).cast("bigint")
        return self._t.orders.select(
            (key % 5).alias("gid"), idx.alias("idx"), ((idx + 0.5) * 2.0).alias("chainage"),
            F.when(F.col("o_orderstatus") == "F", "mapped_overlap")
            .when(F.col("o_orderstatus") == "P", "proximity_only").otherwise("mapped_non_overlap").alias("stratum"))

    @cached_property
    def intervals(self) -> DataFrame:
        start = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 911) % 10000).cast("double") / 10.0
        return self._t.lineitem.select(
            (F.col("l_orderkey") % 1000).alias("route"), start.alias("a"), (start + F.col("l_quantity") / 10.0).alias("b"))

    @cached_property
    def rects(self) -> DataFrame:
        x = ((F.col("p_partkey") * 53) % 1000).cast("double")
        y = ((F.col("p_partkey") * 97) % 1000).cast("double")
        return self._t.part.select(
            F.col("p_partkey").alias("poly_id"), (3 + F.col("p_size") % 2).alias("cls"), x.alias("x1"), y.alias("y1"),
            (x + F.col("p_size") / 4.0).alias("x2"), (y + F.col("p_size") / 4.0).alias("y2"))

    @cached_property
    def vertices(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._t.supplier.select(
            F.floor(key / 5).cast("bigint").alias("gid"), (key % 5 + 1).alias("seq"),
            ((key * 61) % 1000).cast("double").alias("x"), ((key * 89) % 1000).cast("double").alias("y"))
