"""Comparison queries and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.expr import rounded
from freshet.operators import comparisons as c
from freshet.operators import models
from freshet.plans.panels import FLAG_FLOW, FLOW, HYDRO_YEAR, flag_flow, flow, num, pairs, rain, read


def _stations(days):
    def run(spark, d):
        rows = flag_flow(spark, d).join(rain(spark, d), ["gauge_id", "date"]).select("gauge_id", "date", F.col("q").alias("station"), (F.col("p") / 7).alias("product"))
        return rounded(c.station_comparison(rows, days))

    return run


def _spells(spark, d):
    rows = flow(spark, d)
    return rounded(c.spells(rows, F.col("q") > 100))


def _zero(spark, d):
    return rounded(c.zero_flow_frequency(flow(spark, d).withColumn("q", F.when(F.col("q") >= 20, F.col("q")).otherwise(0.0))))


def _correlations(spark, d):
    """Four cells made of flow and price, against both."""
    rows = pairs(spark, d)
    cells = F.array(F.col("obs"), -F.col("sim"), F.col("obs") - F.col("sim"), F.pow("obs", F.lit(2)) / 100)
    processes = rows.select("gauge_id", "date", F.col("obs").alias("flow"), F.col("sim").alias("price"))
    return models.cell_correlations(rows.select("gauge_id", "date", cells.alias("h")), processes, ["flow", "price"])


def _runoff(spark, d):
    n = read(spark, d, "part")
    share = lambda k: (F.col("p_partkey") * k % 11) / 10
    return n.select("p_partkey", c.runoff_class(share(1), share(3), share(2) - 0.5, share(5) - 0.5, share(7), share(4)).alias("runoff"))


QUERIES = {
    "comp_stations_daily": _stations(1),
    "comp_stations_10_days": _stations(10),
    "comp_spells": _spells,
    "comp_zero_flow_frequency": _zero,
    "comp_calendar_half_flow": lambda s, d: rounded(c.calendar_half_flow(flag_flow(s, d))),
    "comp_cell_correlations": lambda s, d: rounded(_correlations(s, d)),
    "comp_assigned_cells": lambda s, d: rounded(c.assigned_cells(_correlations(s, d))),
    "comp_dominant_process": lambda s, d: c.dominant_process(_correlations(s, d), c.assigned_cells(_correlations(s, d))),
    "comp_runoff_class": _runoff,
    "comp_best_epoch": lambda s, d: rounded(models.best_epoch(read(s, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("epoch"), (F.col("l_extendedprice") / 1013).alias("NSE")))),
}

_RAIN = "SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1000 / 7 AS y FROM orders GROUP BY 1"


def _station_sql(days: int) -> str:
    return f"""WITH r AS (SELECT gauge_id, date, q AS x, y FROM ({FLAG_FLOW}) JOIN ({_RAIN}) USING (date)), s AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY gauge_id), date) // {days} AS k FROM r),
      a AS (SELECT gauge_id, k, sum(x) AS x, sum(y) AS y, count(*) AS n FROM s GROUP BY 1, 2), z AS (SELECT gauge_id, CAST(sum(n) AS BIGINT) AS n, sum(y) AS t, 1 - sum(pow(x - y, 2)) / nullif(var_pop(x) * count(*), 0) AS r2,
      covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r, avg(abs((x - y) / nullif(x, 0))) * 100 AS m, sqrt(avg(pow(x - y, 2))) AS e, avg(x - y) AS b FROM a GROUP BY 1)
      SELECT gauge_id, n, {num(**{k: f'CASE WHEN n >= 1000 AND t <> 0 THEN {v} END' for k, v in (('r2', 'r2'), ('pearson', 'r'), ('mae_percent', 'm'), ('rmse', 'e'), ('mean_difference', 'b'))})} FROM z"""


_SHARE = "CAST(p_partkey * {} % 11 AS DOUBLE) / 10"

ORACLE_SQL = {
    "comp_stations_daily": _station_sql(1),
    "comp_stations_10_days": _station_sql(10),
    "comp_spells": f"""WITH ts AS ({FLOW}), m AS (SELECT *, q > 100 AS hit, coalesce(lag(q > 100) OVER (PARTITION BY gauge_id ORDER BY date), false) AS was FROM ts), r AS (SELECT *, sum(CASE WHEN hit AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY gauge_id ORDER BY date) AS run FROM m)
      SELECT gauge_id, CAST(min(date) AS VARCHAR) AS start, count(*) AS rows, {num(total='sum(q)')} FROM r WHERE hit GROUP BY gauge_id, run""",
    "comp_zero_flow_frequency": f"WITH y AS (SELECT gauge_id, {HYDRO_YEAR} AS y, avg(CASE WHEN q < 20 THEN 1.0 ELSE 0.0 END) AS s FROM ({FLOW}) GROUP BY 1, 2) SELECT gauge_id, {num(zero_q_freq='avg(s)')} FROM y GROUP BY 1",
    "comp_calendar_half_flow": f"""WITH ts AS ({FLAG_FLOW}), h AS (SELECT gauge_id, year(date) AS y, sum(q) / 2 AS half FROM ts GROUP BY 1, 2), c AS (SELECT gauge_id, date, {HYDRO_YEAR} AS y, sum(q) OVER (PARTITION BY gauge_id, {HYDRO_YEAR} ORDER BY date) AS s FROM ts)
      SELECT gauge_id, CAST(y AS INTEGER) AS year, CAST(min(date) AS VARCHAR) AS half_date FROM c JOIN h USING (gauge_id, y) WHERE s > half GROUP BY 1, 2""",
    "comp_runoff_class": f"""WITH x AS (SELECT p_partkey, {_SHARE.format(1)} AS clay, {_SHARE.format(3)} AS sand, {_SHARE.format(2)} - 0.5 AS ice, {_SHARE.format(5)} - 0.5 AS urban, {_SHARE.format(7)} AS forest, {_SHARE.format(4)} AS slope FROM part)
      SELECT p_partkey, CASE WHEN ice > 0.5 THEN 'frozen ground' WHEN clay > 0.6 AND slope > 0.3 THEN 'saturation excess' WHEN urban > 0.3 THEN 'sealed surfaces' WHEN sand > 0.6 AND forest > 0.5 THEN 'infiltration under forest'
      WHEN sand > 0.5 THEN 'infiltration' WHEN clay > 0.5 THEN 'mostly surface' ELSE 'mixed' END AS runoff FROM x""",
    "comp_best_epoch": f"""WITH m AS (SELECT l_returnflag AS run, l_linenumber AS epoch, quantile_cont(l_extendedprice / 1013, 0.5) AS m FROM lineitem GROUP BY 1, 2)
      SELECT run, epoch, {num(median='m')} FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY m DESC, epoch) = 1""",
}
