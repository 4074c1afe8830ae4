"""Series panels made from the general tables, in Spark and in SQL.

flow: gauge = nation of the supplier, q = quantity shipped a day. flag_flow: gauge = return flag, whose
series have whole years. rain: p = order value a day, for every gauge of flag_flow. pairs: obs and sim
of a gauge and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity")
    gauges = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("gauge_id"))
    return items.join(gauges, items.l_suppkey == gauges.s_suppkey).groupBy("gauge_id", "date").agg(F.sum("l_quantity").alias("q"))


def flag_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_returnflag").alias("gauge_id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("q"))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.sum("o_totalprice") / 1000).alias("p"))
    gauges = flag_flow(spark, sf_dir).select("gauge_id").distinct()
    return days.crossJoin(F.broadcast(gauges)).select("gauge_id", "date", "p")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice")
    gauges = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("gauge_id"))
    return items.join(gauges, items.l_suppkey == gauges.s_suppkey).groupBy("gauge_id", "date").agg(
        F.sum("l_quantity").alias("obs"), (F.sum("l_extendedprice") / 1500).alias("sim")
    )


FLOW = """SELECT CAST(s_nationkey AS VARCHAR) AS gauge_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
FLAG_FLOW = "SELECT l_returnflag AS gauge_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"
RAIN = f"""SELECT gauge_id, date, p FROM (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1000 AS p FROM orders GROUP BY 1),
  (SELECT DISTINCT gauge_id FROM ({FLAG_FLOW}))"""
PAIRS = """SELECT CAST(s_nationkey AS VARCHAR) AS gauge_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS obs,
  sum(l_extendedprice) / 1500 AS sim FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""

HYDRO_YEAR = "CAST(year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS INTEGER)"
SEASON = """CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring'
  WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""


def num(**columns: str) -> str:
    """SQL of rounded doubles, as rounded() has them."""
    return ", ".join(f"round(CAST({sql} AS DOUBLE), 6) + 0.0 AS {name}" for name, sql in columns.items())


def cv(x: str) -> str:
    return f"stddev_pop({x}) / nullif(avg({x}), 0)"


def positive(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def slope(p1: float = 0.67, p2: float = 0.34) -> str:
    a, b = f"quantile_cont(q, {p1})", f"quantile_cont(q, {p2})"
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN (ln({a}) - ln({b})) / 33 * 100 END"
