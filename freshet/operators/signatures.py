"""Flow signatures: one row per gauge from its daily series (gauge_id, date, q).

Missing days and null values are left out first, so lags, runs and changes are between surviving
rows. A series that a signature needs more of has null there. Two conventions of the field stand side
by side and are named apart: exceedance percentiles (q05 is a high flow, of the flow duration curve)
and plain quantiles (q05_0 is the 5 % quantile).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.expr import by, cv, div, hydro_day, hydro_year, ln, over_positive, quantile, sample_kurtosis, sample_skew, season
from freshet.functions.kernels import lyne_hollick

KEY, TIME, Q = "gauge_id", "date", "q"
SEASONS = ["winter", "spring", "summer", "autumn"]
PERCENTILES = [5, 10, 20, 30, 50, 70, 80, 90, 95, 99]


def present(series: DataFrame) -> DataFrame:
    return series.select(KEY, TIME, Q).where(F.col(Q).isNotNull())


def exceedance(p: float) -> Column:
    """Flow exceeded p percent of the time."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    return quantile(Q, (100 - p) / 100)


def duration_curve(series: DataFrame) -> DataFrame:
    """(gauge_id, rank, exceedance_probability, discharge): Weibull plotting positions rank / (n + 1)."""
    rows = present(series)
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(Q), TIME))
    n = F.count("*").over(Window.partitionBy(KEY))
    return rows.select(KEY, rank.alias("rank"), (rank / (n + 1) * 100).alias("exceedance_probability"), F.col(Q).alias("discharge"))


def _slope(p1: float = 33, p2: float = 66) -> Column:
    return (ln(exceedance(p1)) - ln(exceedance(p2))) / (p2 - p1) * 100


def duration_metrics(series: DataFrame, percentiles: list[int] = PERCENTILES) -> DataFrame:
    """Percentile flows, slope of the duration curve, its ratios, and moments."""
    flows = [exceedance(p).alias(f"q{p:02d}") for p in percentiles]
    q5, q25, q50, q75, q95 = (exceedance(p) for p in (5, 25, 50, 75, 95))
    return present(series).groupBy(KEY).agg(
        *flows, _slope().alias("fdc_slope"),
        over_positive(q5, q95).alias("q5_q95_ratio"), over_positive(q5, q50).alias("q5_q50_ratio"),
        over_positive(q50, q95).alias("q50_q95_ratio"), over_positive(q25 - q75, q50).alias("iqr_median_ratio"),
        F.avg(Q).alias("mean_flow"), F.median(Q).alias("median_flow"), cv(Q).alias("cv_flow"),
        sample_skew(Q).alias("skewness"), sample_kurtosis(Q).alias("kurtosis"),
    )


def regime_classes(series: DataFrame, corrected: bool = False) -> DataFrame:
    """Slope and variability class and the regime that they make. As published the slope's limits are
    negative although the slope never is; corrected=True compares its size instead."""
    rows = present(series).groupBy(KEY).agg(_slope().alias("fdc_slope"), cv(Q).alias("coefficient_variation"))
    slope, spread = (-F.abs("fdc_slope") if corrected else F.col("fdc_slope")), F.col("coefficient_variation")
    rows = rows.withColumn("slope_class", F.when(slope < -1.5, "steep").when(slope > -0.5, "flat").otherwise("moderate"))
    rows = rows.withColumn("variability_class", F.when(spread < 0.5, "low").when(spread > 1.5, "high").otherwise("moderate"))
    a, b = F.col("slope_class"), F.col("variability_class")
    regime = (
        F.when((a == "steep") & (b == "high"), "flashy").when((a == "flat") & (b == "low"), "stable")
        .when(a == "moderate", "intermediate").otherwise(F.concat_ws("_", b, a))
    )
    return rows.select(KEY, regime.alias("flow_regime"), "slope_class", "variability_class", "fdc_slope", "coefficient_variation")


def baseflow_regime(series: DataFrame) -> DataFrame:
    """Regime by slope, variability and the share of low flow, with the published limits."""
    rows = present(series).groupBy(KEY).agg(
        cv(Q).alias("coefficient_of_variation"), _slope().alias("fdc_slope"), over_positive(exceedance(95), F.avg(Q)).alias("baseflow_ratio")
    )
    slope, spread = F.col("fdc_slope"), F.col("coefficient_of_variation")
    known = slope.isNotNull() & spread.isNotNull()
    regime = (
        F.when(~known, "unclassified").when((slope < -2) & (spread > 1), "flashy")
        .when((slope > -0.8) & (spread < 0.7), "baseflow_dominated").when(slope.between(-2, -0.8), "intermediate").otherwise("variable")
    )
    return rows.select(KEY, regime.alias("regime_classification"), "coefficient_of_variation", "fdc_slope", "baseflow_ratio")


def events(series: DataFrame, mask: Column) -> DataFrame:
    """(gauge_id, start, end, duration): runs of the (present) rows where mask holds. An event ends with the first row
    after it, or with the series, and its duration counts both ends."""
    w = by(KEY, TIME)
    rows = series.withColumn("_on", F.coalesce(mask, F.lit(False))).withColumn("_next", F.lead(TIME).over(w))
    begins = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    rows = rows.withColumn("_run", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    runs = rows.groupBy(KEY, "_run").agg(F.min(TIME).alias("start"), F.coalesce(F.max("_next"), F.max(TIME)).alias("end"))
    return runs.select(KEY, "start", "end", (F.datediff("end", "start") + 1).alias("duration"))


def _with_stats(series: DataFrame, **stats: Column) -> DataFrame:
    """The rows with statistics of their gauge."""
    rows = present(series)
    return rows.join(rows.groupBy(KEY).agg(*(c.alias(n) for n, c in stats.items())), KEY)


def _flows(series: DataFrame, name: str, high: bool, base: Column, factor: float, extreme: str) -> DataFrame:
    rows = _with_stats(series, _t=base * factor)
    mask = F.col(Q) > F.col("_t") if high else F.col(Q) < F.col("_t")
    inside = F.when(mask, F.col(Q))
    far = F.max(inside) if high else F.min(inside)
    base_rows = rows.groupBy(KEY).agg(
        F.first("_t").alias(f"{name}_threshold"), (F.count(inside) / F.count("*") * 100).alias(f"{name}_frequency"),
        F.avg(inside).alias(f"{name}_mean"), far.alias(f"{name}_{extreme}"),
    )
    runs = events(rows, mask).groupBy(KEY).agg(
        F.count("*").alias("_n"), F.avg("duration").alias("_a"), F.max("duration").cast("double").alias("_m")
    )
    return base_rows.join(runs, KEY, "left").select(
        *base_rows.columns, F.coalesce("_n", F.lit(0)).alias(f"{name}_events"),
        F.coalesce("_a", F.lit(0.0)).alias(f"{name}_avg_duration"), F.coalesce("_m", F.lit(0.0)).alias(f"{name}_max_duration"),
    )


def high_flows(series: DataFrame, factor: float = 2.0) -> DataFrame:
    """Flows above factor times the median: share, size, events."""
    return _flows(series, "high_flow", True, F.median(Q), factor, "max")


def low_flows(series: DataFrame, factor: float = 0.2) -> DataFrame:
    """Flows below factor times the mean."""
    return _flows(series, "low_flow", False, F.avg(Q), factor, "min")


def flow_quantiles(series: DataFrame, quantiles: tuple[float, ...] = (0.01, 0.05, 0.1, 0.9, 0.95, 0.99)) -> DataFrame:
    names = {p: f"q{p * 100:04.1f}".replace(".", "_") for p in quantiles}
    return present(series).groupBy(KEY).agg(*(quantile(Q, p).alias(n) for p, n in names.items()))


def drought_indices(series: DataFrame) -> DataFrame:
    rows = _with_stats(series, q95_flow=quantile(Q, 0.05), q90_flow=quantile(Q, 0.1), _mean=F.avg(Q), _median=F.median(Q))
    low = F.when(F.col(Q) <= F.col("q95_flow"), F.col(Q))
    return rows.groupBy(KEY).agg(
        F.first("q95_flow").alias("q95_flow"), F.first("q90_flow").alias("q90_flow"),
        over_positive(F.first("q95_flow"), F.first("_mean")).alias("bfi_approx"),
        div(F.stddev_pop(low), F.avg(low)).alias("low_flow_cv"),
        over_positive(F.first("q95_flow"), F.first("_median")).alias("q95_ratio"),
    )


def annual_maxima(series: DataFrame, more_than: int = 300) -> DataFrame:
    """(gauge_id, year, peak) of calendar years with more than so many rows."""
    rows = present(series).groupBy(KEY, F.year(TIME).alias("year")).agg(F.max(Q).alias("peak"), F.count("*").alias("_n"))
    return rows.where(F.col("_n") > more_than).drop("_n")


def flood_indices(series: DataFrame) -> DataFrame:
    rows = present(series)
    peaks = annual_maxima(series).groupBy(KEY).agg(F.avg("peak").alias("_peak"))
    means = rows.groupBy(KEY).agg(F.avg(Q).alias("_mean")).join(peaks, KEY, "left")
    rise = F.col(Q) - F.lag(Q).over(by(KEY, TIME))
    rows = rows.withColumn("_rise", rise).join(means, KEY).withColumn("_flood", F.coalesce("_peak", "_mean"))
    up = F.when(F.col("_rise") > 0, F.col("_rise"))
    return rows.groupBy(KEY).agg(
        quantile(Q, 0.95).alias("q05_flow"), quantile(Q, 0.9).alias("q10_flow"),
        F.first("_flood").alias("mean_annual_flood"), (2 * F.first("_flood")).alias("flood_threshold"),
        (F.count_if(F.col(Q) > 2 * F.col("_flood")) / F.count("*") * 100).alias("flood_frequency"),
        F.max("_rise").alias("max_daily_rise"), F.avg(up).alias("mean_daily_rise"),
        over_positive(F.max("_rise"), F.first("_mean")).alias("flood_flashiness"),
    )


def extreme_ratios(series: DataFrame) -> DataFrame:
    high, mid, low = (quantile(Q, p) for p in (0.95, 0.5, 0.05))
    return present(series).groupBy(KEY).agg(
        over_positive(high, low).alias("q05_q95_ratio"), over_positive(high, mid).alias("q05_q50_ratio"),
        over_positive(mid, low).alias("q50_q95_ratio"), over_positive(high - low, mid).alias("extreme_range_ratio"),
    )


def joined(*parts: DataFrame, key: str = KEY) -> DataFrame:
    """Column blocks of the same gauges side by side."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts)


def extreme_metrics(series: DataFrame) -> DataFrame:
    return joined(flow_quantiles(series), high_flows(series), low_flows(series), drought_indices(series), flood_indices(series))


def half_flow_date(series: DataFrame, least_rows: int = 300) -> DataFrame:
    """Mean and spread, over hydrological years of least_rows or more, of the day by which half of
    the year's flow has passed."""
    rows = present(series).withColumn("_y", hydro_year(TIME))
    year = Window.partitionBy(KEY, "_y")
    rows = rows.select(
        KEY, TIME, "_y", F.sum(Q).over(year.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"),
        F.sum(Q).over(year).alias("_all"), F.count("*").over(year).alias("_n"),
    )
    first = rows.where((F.col("_n") >= least_rows) & (F.col("_sum") >= F.col("_all") / 2)).groupBy(KEY, "_y").agg(F.min(TIME).alias("_d"))
    found = first.groupBy(KEY).agg(F.avg(hydro_day("_d")).alias("hfd_mean"), F.stddev_pop(hydro_day("_d")).alias("hfd_std"))
    return present(series).select(KEY).distinct().join(found, KEY, "left")


def seasonal_flows(series: DataFrame) -> DataFrame:
    rows = present(series).withColumn("_s", season(TIME))
    out = []
    for name in SEASONS:
        own = F.when(F.col("_s") == name, F.col(Q))
        out += [F.avg(own).alias(f"{name}_mean"), F.stddev_pop(own).alias(f"{name}_std"), div(F.stddev_pop(own), F.avg(own)).alias(f"{name}_cv")]
    ratios = [div(F.avg(F.when(F.col("_s") == n, F.col(Q))), F.avg(Q)).alias(f"{n}_ratio") for n in SEASONS]
    return rows.groupBy(KEY).agg(*out, *ratios)


def _extreme_days(series: DataFrame, enough: Column) -> DataFrame:
    """Day of the year of the first highest and first lowest flow of each year with enough rows."""
    early = -F.unix_date(TIME)
    rows = present(series).groupBy(KEY, F.year(TIME).alias("year")).agg(
        F.count("*").alias("_n"), F.max_by(TIME, F.struct(Q, early)).alias("_high"), F.min_by(TIME, F.struct(F.col(Q), F.unix_date(TIME))).alias("_low")
    )
    return rows.where(enough).select(KEY, "year", F.dayofyear("_high").alias("high"), F.dayofyear("_low").alias("low"))


def extreme_timing(series: DataFrame) -> DataFrame:
    days = _extreme_days(series, F.col("_n") >= 300)
    found = days.groupBy(KEY).agg(
        F.avg("high").alias("max_timing_mean"), F.stddev_pop("high").alias("max_timing_std"),
        F.avg("low").alias("min_timing_mean"), F.stddev_pop("low").alias("min_timing_std"),
    )
    return present(series).select(KEY).distinct().join(found, KEY, "left")


def timing_metrics(series: DataFrame) -> DataFrame:
    high = high_flows(series).select(KEY, F.col("high_flow_frequency").alias("high_flow_freq"), "high_flow_avg_duration", "high_flow_max_duration")
    low = low_flows(series).select(KEY, F.col("low_flow_frequency").alias("low_flow_freq"), "low_flow_avg_duration", "low_flow_max_duration")
    return joined(half_flow_date(series), seasonal_flows(series), extreme_timing(series), high, low)


def regime_stability(series: DataFrame) -> DataFrame:
    """Variation between years of each season's mean, over calendar years of 300 rows or more."""
    rows = present(series).withColumn("_y", F.year(TIME)).withColumn("_n", F.count("*").over(Window.partitionBy(KEY, F.year(TIME))))
    means = rows.where("_n >= 300").groupBy(KEY, "_y", season(TIME).alias("_s")).agg(F.avg(Q).alias("_m"))
    own = {n: F.when(F.col("_s") == n, F.col("_m")) for n in SEASONS}
    found = means.groupBy(KEY).agg(*(F.when(F.count(x) > 1, div(F.stddev_pop(x), F.avg(x))).alias(f"{n}_interannual_cv") for n, x in own.items()))
    return present(series).select(KEY).distinct().join(found, KEY, "left")


def basic_statistics(series: DataFrame) -> DataFrame:
    return present(series).groupBy(KEY).agg(
        F.avg(Q).alias("mean"), F.median(Q).alias("median"), F.stddev_pop(Q).alias("std"), F.var_pop(Q).alias("variance"), cv(Q).alias("cv"),
        sample_skew(Q).alias("skewness"), sample_kurtosis(Q).alias("kurtosis"), F.min(Q).alias("min"), F.max(Q).alias("max"),
        (F.max(Q) - F.min(Q)).alias("range"), (quantile(Q, 0.75) - quantile(Q, 0.25)).alias("iqr"),
    )


def temporal_variability(series: DataFrame) -> DataFrame:
    w = by(KEY, TIME)
    rows = present(series).select(KEY, TIME, Q, (F.col(Q) - F.lag(Q).over(w)).alias("_d"), F.row_number().over(w).alias("_i"), F.avg(Q).over(w.rowsBetween(-6, 0)).alias("_w"))
    rows = rows.withColumn("_w", F.when(F.col("_i") >= 7, F.col("_w")))
    rows = rows.withColumn("_wd", F.col("_w") - F.lag("_w").over(w))
    n = F.count("*")
    daily = rows.groupBy(KEY).agg(
        F.avg("_d").alias("daily_change_mean"), F.stddev_pop("_d").alias("daily_change_std"),
        div(F.stddev_pop("_d"), F.abs(F.avg("_d"))).alias("daily_change_cv"),
        F.when(n > 7, F.stddev_pop("_wd")).alias("weekly_change_std"), F.when(n > 7, cv("_w")).alias("weekly_cv"), n.alias("_n"),
    )
    months = present(series).groupBy(KEY, F.trunc(TIME, "month").alias("_m")).agg(F.avg(Q).alias("_v"))
    monthly = months.groupBy(KEY).agg(F.when(F.count("*") > 1, cv("_v")).alias("_mcv"))
    return daily.join(monthly, KEY).select(*daily.columns[:-1], F.when(F.col("_n") > 30, F.col("_mcv")).alias("monthly_cv"))


def autocorrelation(series: DataFrame, lags: tuple[int, ...] = (1, 7, 30, 365)) -> DataFrame:
    """Correlation with the series so many rows before; at lag 1 a constant series has 0."""
    w = by(KEY, TIME)
    rows = present(series).select(KEY, F.col(Q).alias("_x"), *(F.lag(Q, k).over(w).alias(f"_l{k}") for k in lags))
    out = []
    for k in lags:
        x, y = F.when(F.col(f"_l{k}").isNotNull(), F.col("_x")), F.col(f"_l{k}")
        r = div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        out.append((F.when(F.count("*") > 1, F.coalesce(r, F.lit(0.0))) if k == 1 else r).alias(f"lag{k}_autocorr"))
    return rows.groupBy(KEY).agg(*out)


def flashiness(series: DataFrame) -> DataFrame:
    """Richards-Baker index: sum of changes over sum of flows, the first row aside."""
    rows = present(series).withColumn("_d", F.abs(F.col(Q) - F.lag(Q).over(by(KEY, TIME))))
    after = F.when(F.col("_d").isNotNull(), F.col(Q))
    return rows.groupBy(KEY).agg(
        over_positive(F.sum("_d"), F.sum(after)).alias("flashiness_index"), F.avg("_d").alias("mean_abs_daily_change"),
        F.max("_d").alias("max_abs_daily_change"), div(F.stddev_pop("_d"), F.avg("_d")).alias("cv_daily_changes"),
    )


def seasonal_variability(series: DataFrame) -> DataFrame:
    months = present(series).groupBy(KEY, F.month(TIME).alias("_m")).agg(F.avg(Q).alias("_v"), F.stddev_samp(Q).alias("_s"))
    return months.groupBy(KEY).agg(
        cv("_v").alias("seasonal_cv"), (F.max("_v") - F.min("_v")).alias("seasonal_range"), F.max("_v").alias("max_monthly_mean"),
        F.min("_v").alias("min_monthly_mean"), over_positive(F.max("_v"), F.min("_v")).alias("seasonal_ratio"),
        F.avg(div("_s", "_v")).alias("avg_within_month_cv"),
    )


def interannual_variability(series: DataFrame) -> DataFrame:
    years = present(series).groupBy(KEY, F.year(TIME).alias("_y")).agg(F.avg(Q).alias("_v"), F.max(Q).alias("_h"), F.min(Q).alias("_l"))
    years = years.withColumn("_i", F.row_number().over(by(KEY, "_y")).cast("double"))
    n = F.count("*")
    return years.groupBy(KEY).agg(
        *(F.when(n >= 2, x).alias(name) for name, x in (
            ("interannual_cv", cv("_v")), ("max_annual_ratio", div(F.max("_v"), F.min("_v"))), ("annual_max_cv", cv("_h")), ("annual_min_cv", cv("_l")),
        )),
        F.when(n >= 3, F.regr_slope("_v", "_i")).alias("annual_trend"),
    )


def variability_metrics(series: DataFrame) -> DataFrame:
    return joined(
        basic_statistics(series), temporal_variability(series), autocorrelation(series), flashiness(series),
        seasonal_variability(series), interannual_variability(series),
    )


def stability_index(series: DataFrame) -> DataFrame:
    spread = present(series).groupBy(KEY).agg(cv(Q).alias("_cv"))
    rows = joined(spread, autocorrelation(series, (1,)), flashiness(series).select(KEY, "flashiness_index"))
    rows = rows.select(
        KEY, F.least(F.col("_cv") / 2, F.lit(1.0)).alias("cv_component"), F.greatest(F.lit(0.0), F.col("lag1_autocorr")).alias("autocorr_component"),
        F.when(F.col("flashiness_index").isNull(), 0.5).otherwise(F.least(F.col("flashiness_index") / 0.5, F.lit(1.0))).alias("flashiness_component"),
    )
    index = 1 - (F.col("cv_component") * 0.4 + (1 - F.col("autocorr_component")) * 0.3 + F.col("flashiness_component") * 0.3)
    return rows.select(KEY, F.greatest(F.lit(0.0), F.least(F.lit(1.0), index)).alias("stability_index"), *rows.columns[1:])


def magnitude_indices(series: DataFrame) -> DataFrame:
    """ma01 mean, ma02 median, ma15 and ma16 spread, ma03 to ma14 the means of the months there are, in order."""
    months = present(series).groupBy(KEY, F.month(TIME).alias("_m")).agg(F.avg(Q).alias("_v"))
    months = months.withColumn("_i", F.row_number().over(by(KEY, "_m")))
    wide = months.groupBy(KEY).agg(*(F.max(F.when(F.col("_i") == i + 1, F.col("_v"))).alias(f"ma{i + 3:02d}") for i in range(12)))
    own = present(series).groupBy(KEY).agg(
        F.avg(Q).alias("ma01"), F.median(Q).alias("ma02"), F.stddev_pop(Q).alias("ma15"), over_positive(F.stddev_pop(Q), F.avg(Q)).alias("ma16")
    )
    return joined(own, wide)


def frequency_duration_indices(series: DataFrame) -> DataFrame:
    """Flows above 3 medians and below a tenth of the mean: share, pulses (rises of the mask; a series
    that begins inside an event doesn't count it), mean and longest event."""
    rows = _with_stats(series, _h=3 * F.median(Q), _l=0.1 * F.avg(Q))
    masks = {"h": F.col(Q) > F.col("_h"), "l": F.col(Q) < F.col("_l")}
    w, out, runs = by(KEY, TIME), [], []
    marked = rows.select(KEY, TIME, *(m.alias(f"_on_{k}") for k, m in masks.items()))
    marked = marked.select("*", *((F.col(f"_on_{k}") & ~F.lag(f"_on_{k}").over(w)).alias(f"_up_{k}") for k in masks))
    for k in masks:
        out += [(F.count_if(f"_on_{k}") / F.count("*") * 100).alias(f"f{k}01"), F.count_if(f"_up_{k}").cast("double").alias(f"f{k}02")]
        found = events(rows, masks[k]).groupBy(KEY).agg(F.avg("duration").alias(f"d{k}01"), F.max("duration").cast("double").alias(f"d{k}02"))
        runs.append(found)
    table = joined(marked.groupBy(KEY).agg(*out), *runs)
    return table.na.fill(0.0, ["dh01", "dh02", "dl01", "dl02"])


def timing_indices(series: DataFrame) -> DataFrame:
    days = _extreme_days(series, F.col("_n") > 300).groupBy(KEY).agg(F.avg("high").alias("ta01"), F.avg("low").alias("ta02"))
    return present(series).select(KEY).distinct().join(days, KEY, "left")


def rate_indices(series: DataFrame) -> DataFrame:
    """Means and medians of rises and falls, and ra05, the changes that differ from the change before
    them, the first change included."""
    w = by(KEY, TIME)
    rows = present(series).withColumn("_d", F.col(Q) - F.lag(Q).over(w))
    rows = rows.withColumn("_dd", F.col("_d") - F.lag("_d").over(w)).where("_d is not null")
    up, down = F.when(F.col("_d") > 0, F.col("_d")), F.when(F.col("_d") < 0, -F.col("_d"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.groupBy(KEY).agg(
        zero(F.avg(up)).alias("ra01"), zero(F.median(up)).alias("ra02"), zero(F.avg(down)).alias("ra03"), zero(F.median(down)).alias("ra04"),
        F.count_if(F.col("_dd").isNull() | (F.col("_dd") != 0)).cast("double").alias("ra05"),
    )


def comprehensive(series: DataFrame, baseflow: DataFrame | None = None) -> DataFrame:
    """All signatures, their names prefixed by their family; baseflow: (gauge_id, bfi)."""
    parts = {
        "magnitude": magnitude_indices(series), "frequency_duration": frequency_duration_indices(series), "timing": timing_indices(series),
        "rate": rate_indices(series), "fdc": duration_metrics(series), "extreme": extreme_metrics(series),
        "timing_detailed": timing_metrics(series), "variability": variability_metrics(series),
    }
    if baseflow is not None:
        parts["baseflow"] = baseflow
    return joined(*(p.select(KEY, *(F.col(c).alias(f"{name}_{c}") for c in p.columns if c != KEY)) for name, p in parts.items()))


def baseflow_index(series: DataFrame, keys: tuple[str, ...] = (KEY,), alpha: float | None = None, ensemble: int = 1000, passes: int = 3, reflect: int = 30) -> DataFrame:
    """(keys, baseflow_index): share of the Lyne-Hollick baseflow, for each group of rows (keys, date, q):
    of one alpha, or the mean over an even grid of `ensemble` alphas from 0.9 to 0.98. The filter is a
    recursion over the days, so a group is one batch of a kernel."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    alphas = np.array([alpha]) if alpha is not None else 0.9 + 0.08 * (np.arange(ensemble) + 0.5) / ensemble

    def run(frame):
        q = frame.sort_values(TIME)[Q].to_numpy(float)
        found = frame[list(keys)].head(1).copy()
        parts = [lyne_hollick(q, part, passes, reflect)[0] for part in np.array_split(alphas, max(1, len(alphas) // 100))] if len(q) > 1 else []
        found["baseflow_index"] = float(np.concatenate(parts).mean()) if parts else None
        return found

    rows = series.select(*keys, TIME, Q).where(F.col(Q).isNotNull())
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", baseflow_index double")


def period_metrics(series: DataFrame, period: Column | None = None, min_fraction: float = 0.7, baseflow: bool = True) -> DataFrame:
    """Signatures of every hydrological year (or of the periods given): (gauge_id, period, ...). A
    period with less than min_fraction of its rows present has null metrics. Feed rows with nulls.
    baseflow: the baseflow index too, the one metric that is a kernel."""
    rows = series.select(F.col(KEY).alias("_g"), TIME, Q, (hydro_year(TIME) if period is None else period).alias("period"))
    own = F.struct("_g", "period")
    shares = rows.groupBy("_g", "period").agg((F.count(Q) / F.count("*")).alias("_share"))
    inner = rows.select(F.to_json(own).alias(KEY), TIME, Q)
    total = present(inner).groupBy(KEY).agg(
        F.avg(Q).alias("mean_discharge"), F.median(Q).alias("median_discharge"), F.stddev_pop(Q).alias("std_discharge"),
        F.sum(Q).alias("total_discharge"), over_positive(F.stddev_pop(Q), F.avg(Q)).alias("cv_discharge"),
        _slope().alias("fdc_slope"), exceedance(5).alias("q05"), exceedance(50).alias("q50"), exceedance(95).alias("q95"),
    )
    high = high_flows(inner).select(KEY, "high_flow_frequency", "high_flow_avg_duration")
    low = low_flows(inner).select(KEY, "low_flow_frequency", "low_flow_avg_duration")
    half = half_flow_date(inner).select(KEY, F.col("hfd_mean").alias("mean_half_flow_date"))
    parts = [total, high, low, half] + ([baseflow_index(inner, (KEY,))] if baseflow else [])
    table = joined(*parts)
    names = table.columns[1:]
    keyed = shares.withColumn(KEY, F.to_json(own)).join(table, KEY, "left")
    enough = F.col("_share") >= min_fraction
    return keyed.select(F.col("_g").alias(KEY), "period", *(F.when(enough, F.col(c)).alias(c) for c in names))


def aggregated_periods(metrics: DataFrame, how: str = "mean", min_periods: int = 3) -> DataFrame:
    """Mean, median or spread over the periods of each metric with enough of them."""
    steps = {"mean": F.avg, "median": F.median, "std": F.stddev_pop}
    if how not in steps:
        raise ValueError(f"aggregation must be one of {sorted(steps)}")
    names = [c for c in metrics.columns if c not in (KEY, "period")]
    enough = F.count("*") >= min_periods
    out = [F.when(enough & (F.count(c) >= min_periods), steps[how](F.col(c))).alias(c) for c in names]
    spread = F.when(enough, F.stddev_pop("mean_discharge"))
    rows = metrics.groupBy(KEY).agg(*out, F.when(enough, F.count("*")).alias("n_valid_periods"), spread.alias("mean_discharge_std"))
    return rows.withColumn("mean_discharge_cv", over_positive("mean_discharge_std", "mean_discharge"))


def runoff_ratio(series: DataFrame, rain: DataFrame, min_periods: int = 3) -> DataFrame:
    """(gauge_id, runoff_ratio): mean over common hydrological years of flow over rain (gauge_id, date, p)."""
    q = series.groupBy(KEY, hydro_year(TIME).alias("_y")).agg(F.sum(Q).alias("_q"))
    p = rain.groupBy(KEY, hydro_year(TIME).alias("_y")).agg(F.sum("p").alias("_p"))
    ratio = over_positive("_q", "_p")
    return q.join(p, [KEY, "_y"]).groupBy(KEY).agg(F.when(F.count(ratio) >= min_periods, F.avg(ratio)).alias("runoff_ratio"))
