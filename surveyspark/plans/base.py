"""Tables and registration for the queries: each is a function of ``Tables``, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: One row a person: a line of an order; the order is the household, the customer's nation the sector, its region the district.
PERSON_SQL = """person AS (
  SELECT l_orderkey AS hhid, l_linenumber AS pid, l_quantity AS wt, 1 + p_size AS age, l_linestatus AS sex, year(o_orderdate)::INTEGER AS wave,
    month(o_orderdate)::INTEGER AS month, c_nationkey AS sector, n_regionkey AS dist, l_returnflag AS cls, l_extendedprice AS value, l_discount AS disc, l_tax AS tax,
    l_partkey AS partkey, l_suppkey AS suppkey, p_size AS size, p_brand AS brand, p_type AS type, o_orderpriority AS priority, c_mktsegment AS segment, o_custkey AS custkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
#: Sector by year, complete from 1995 to 2000.
PANEL_SQL = PERSON_SQL + """, panel AS (
  SELECT sector, dist, wave, round(sum(wt), 4) / 1000 AS y, round(sum(value), 2) / 1e6 AS x, round(avg(disc), 6) AS z, count(*)::BIGINT AS n
  FROM person WHERE wave BETWEEN 1995 AND 2000 GROUP BY sector, dist, wave)"""


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def person(self) -> DataFrame:
        lines = self["lineitem"].join(self["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(self["part"], F.col("l_partkey") == F.col("p_partkey"))
        lines = lines.join(self["customer"], F.col("o_custkey") == F.col("c_custkey")).join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        return lines.select(
            F.col("l_orderkey").alias("hhid"), F.col("l_linenumber").alias("pid"), F.col("l_quantity").alias("wt"), (1 + F.col("p_size")).alias("age"), F.col("l_linestatus").alias("sex"), F.year("o_orderdate").alias("wave"),
            F.month("o_orderdate").alias("month"), F.col("c_nationkey").alias("sector"), F.col("n_regionkey").alias("dist"), F.col("l_returnflag").alias("cls"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
            F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("o_custkey").alias("custkey"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        rows = self.person.filter(F.col("wave").between(1995, 2000)).groupBy("sector", "dist", "wave")
        return rows.agg((F.round(F.sum("wt"), 4) / 1000).alias("y"), (F.round(F.sum("value"), 2) / 1e6).alias("x"), F.round(F.avg("disc"), 6).alias("z"), F.count("*").alias("n"))


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``. In ``sql``, @person and @panel stand for the tables above."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip().replace("@person", PERSON_SQL).replace("@panel", PANEL_SQL)
        return f

    return add
