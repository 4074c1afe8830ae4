"""Stations against gridded products, spells by plain run lengths, state cells, and runoff classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.expr import by, div, hydro_year, pearson
from freshet.operators.signatures import KEY, Q, TIME, present


def station_comparison(rows: DataFrame, days: int = 1, least: int = 1000) -> DataFrame:
    """(gauge_id, n, r2, pearson, mae_percent, rmse, mean_difference) of sums over spans of so many days
    from the first, of station and product; null where fewer than `least` days or an all-zero product."""
    both = rows.where(F.col("station").isNotNull() & F.col("product").isNotNull())
    first = F.min(TIME).over(Window.partitionBy(KEY))
    span = F.floor(F.datediff(TIME, first) / days)
    spans = both.select(KEY, span.alias("_s"), "station", "product").groupBy(KEY, "_s").agg(
        F.sum("station").alias("x"), F.sum("product").alias("y"), F.count("*").alias("_n")
    )
    x, y = F.col("x"), F.col("y")
    known = (F.sum("_n") >= least) & (F.sum(y) != 0)
    scores = {
        "r2": 1 - div(F.sum(F.pow(x - y, 2)), F.var_pop(x) * F.count("*")), "pearson": pearson(x, y), "mae_percent": F.avg(F.abs(div(x - y, x))) * 100,
        "rmse": F.sqrt(F.avg(F.pow(x - y, 2))), "mean_difference": F.avg(x - y),
    }
    return spans.groupBy(KEY).agg(F.sum("_n").alias("n"), *(F.when(known, v).alias(k) for k, v in scores.items()))


def spells(series: DataFrame, mask: Column) -> DataFrame:
    """(gauge_id, start, rows, total): runs of rows where mask holds, by their plain number of rows."""
    w = by(KEY, TIME)
    rows = series.withColumn("_on", F.coalesce(mask, F.lit(False)))
    begins = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    rows = rows.withColumn("_run", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    return rows.groupBy(KEY, "_run").agg(F.min(TIME).alias("start"), F.count("*").alias("rows"), F.sum(Q).alias("total")).drop("_run")


def zero_flow_frequency(series: DataFrame) -> DataFrame:
    """(gauge_id, zero_q_freq): mean over hydrological years of the share of rows without flow."""
    years = present(series).groupBy(KEY, hydro_year(TIME).alias("_y")).agg(F.avg((F.col(Q) == 0).cast("double")).alias("_s"))
    return years.groupBy(KEY).agg(F.avg("_s").alias("zero_q_freq"))


def calendar_half_flow(series: DataFrame) -> DataFrame:
    """(gauge_id, year, half_date): first day of a hydrological year whose cumulated flow exceeds half of
    the total of the calendar year in which it ends."""
    rows = present(series)
    half = rows.groupBy(KEY, F.year(TIME).alias("year")).agg((F.sum(Q) / 2).alias("_half"))
    rows = rows.withColumn("year", hydro_year(TIME))
    rows = rows.withColumn("_sum", F.sum(Q).over(Window.partitionBy(KEY, "year").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(half, [KEY, "year"]).where("_sum > _half").groupBy(KEY, "year").agg(F.min(TIME).alias("half_date"))


def assigned_cells(correlations: DataFrame, least: float = 0.1) -> DataFrame:
    """(cell, group, r, z): every cell's signed process from (gauge_id, cell, process, r): the sign and
    process in which its mean correlation stands out most among the cells (standard score), if that
    correlation reaches `least`; else the process of its largest correlation, if that does; else inactive."""
    mean = correlations.groupBy("cell", "process").agg(F.avg("r").alias("m"))
    sides = F.array(F.struct(F.lit("pos").alias("s"), F.greatest("m", F.lit(0.0)).alias("v")), F.struct(F.lit("neg").alias("s"), F.greatest(-F.col("m"), F.lit(0.0)).alias("v")))
    rows = mean.select("cell", "process", "m", F.explode(sides).alias("_o")).select("cell", "process", "m", F.col("_o.s").alias("s"), F.col("_o.v").alias("v"))
    w = Window.partitionBy("process", "s")
    rows = rows.withColumn("z", (F.col("v") - F.avg("v").over(w)) / (F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)) + 1e-8))
    best = F.max_by(F.struct("process", "s", "m"), F.struct(F.col("z"), F.col("s"), F.col("process")))
    large = F.max_by(F.struct("process", "m"), F.struct(F.abs("m"), F.col("process")))
    out = rows.groupBy("cell").agg(best.alias("b"), large.alias("l"), F.max("z").alias("z"))
    signed = F.when(F.col("b.s") == "pos", F.col("b.m")).otherwise(-F.abs("b.m"))
    by_z, by_size = F.abs("b.m") >= least, F.abs("l.m") >= least
    sign = F.when(F.col("l.m") > 0, "_pos").otherwise("_neg")
    group = F.when(by_z, F.concat_ws("_", "b.process", "b.s")).when(by_size, F.concat("l.process", sign)).otherwise("inactive")
    return out.select("cell", group.alias("group"), F.when(by_z, signed).when(by_size, F.col("l.m")).otherwise(0.0).alias("r"), "z")


def dominant_process(correlations: DataFrame, assigned: DataFrame) -> DataFrame:
    """(gauge_id, group): the group of cells with the largest mean absolute correlation at each gauge."""
    rows = correlations.join(assigned.where("group <> 'inactive'").select("cell", "group"), "cell")
    rows = rows.where(F.expr("startswith(group, process)")).groupBy(KEY, "group").agg(F.avg(F.abs("r")).alias("_m"))
    return rows.groupBy(KEY).agg(F.max_by("group", F.struct(F.col("_m"), F.col("group"))).alias("group"))


def runoff_class(clay: Column, sand: Column, permafrost: Column, urban: Column, forest: Column, slope: Column) -> Column:
    """How a catchment forms its runoff, by attributes scaled to 0 to 1; the first rule that holds."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    clay, sand, permafrost, urban, forest, slope = map(zero, (clay, sand, permafrost, urban, forest, slope))
    return (
        F.when(permafrost > 0.5, "frozen ground").when((clay > 0.6) & (slope > 0.3), "saturation excess").when(urban > 0.3, "sealed surfaces")
        .when((sand > 0.6) & (forest > 0.5), "infiltration under forest").when(sand > 0.5, "infiltration").when(clay > 0.5, "mostly surface").otherwise("mixed")
    )
