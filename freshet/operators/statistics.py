"""Trend, homogeneity and change points of series (gauge_id, date, q), one or more rows per gauge.

Tests are expressed with windows and aggregates; the running sums and ranks replace the quadratic
and cubic loops that define them. p-values that need a t or chi-square distribution, and detectors
that reset or recurse, run as grouped kernels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.distributions import chi2_sf, t_two_sided
from freshet.functions.expr import by, div, pearson
from freshet.operators.signatures import KEY, Q, TIME, present


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal z: an approximation of erfc by a rational function, 1.2e-7 at worst."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    terms = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    poly = F.lit(0.0)
    for c in terms:
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def annual(series: DataFrame) -> DataFrame:
    """(gauge_id, date, q): means of calendar years, dated at their last day."""
    return present(series).groupBy(KEY, F.year(TIME).alias("_y")).agg(F.avg(Q).alias(Q)).select(
        KEY, F.make_date("_y", F.lit(12), F.lit(31)).alias(TIME), Q
    )


def linear_trend(series: DataFrame) -> DataFrame:
    """Least squares over whole years since the first: slope, intercept, r2, standard error, t, per
    decade, direction; at least 3 rows."""
    rows = present(series).withColumn("_x", (F.year(TIME) - F.min(F.year(TIME)).over(Window.partitionBy(KEY))).cast("double"))
    fit = rows.groupBy(KEY).agg(
        F.count("*").alias("n"), F.regr_slope(Q, "_x").alias("slope"), F.regr_intercept(Q, "_x").alias("intercept"), pearson(Q, "_x").alias("_r"),
        (F.var_pop(Q) * F.count("*")).alias("_yy"), (F.var_pop("_x") * F.count("*")).alias("_xx"),
    ).where("n >= 3")
    error = F.sqrt(div(F.greatest(F.lit(0.0), F.col("_yy") * (1 - F.pow("_r", F.lit(2)))), F.col("_xx") * (F.col("n") - 2)))
    return fit.select(
        KEY, "n", "slope", "intercept", F.pow("_r", F.lit(2)).alias("r_squared"), error.alias("std_err"), div(F.col("slope"), error).alias("t_statistic"),
        (F.col("slope") * 10).alias("trend_per_decade"), F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("no trend").alias("direction"),
    )


def with_p_value(fit: DataFrame) -> DataFrame:
    """linear_trend's rows with p_value of the slope, from the t distribution."""

    def run(frames):
        for f in frames:
            f["p_value"] = [
                None if t is None or np.isnan(t) else t_two_sided(t, n - 2) for t, n in zip(f["t_statistic"].to_numpy(float, na_value=np.nan), f["n"])
            ]
            yield f

    return fit.mapInPandas(run, fit.schema.simpleString()[7:-1].replace(":", " ") + ", p_value double")


def mann_kendall(series: DataFrame, alpha: float = 0.05, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """S, its variance with the tie correction, z, p, tau and Sen's slope (median over pairs, per row).

    The pairs of a gauge are joined by key and an inequality: meant for annual or monthly series. For
    daily ones take annual() first."""
    order = Window.partitionBy(*keys).orderBy(TIME)
    rows = series.where(F.col(Q).isNotNull()).select(*keys, Q, F.row_number().over(order).alias("_i"))
    a = rows.select(*keys, F.col(Q).alias("_a"), F.col("_i").alias("_ia"))
    b = rows.select(*keys, F.col(Q).alias("_b"), F.col("_i").alias("_ib"))
    pairs = a.join(b, list(keys)).where("_ib > _ia")
    sums = pairs.groupBy(*keys).agg(
        F.sum(F.signum(F.col("_b") - F.col("_a"))).alias("s"), F.median((F.col("_b") - F.col("_a")) / (F.col("_ib") - F.col("_ia"))).alias("sen_slope")
    )
    t = F.col("_t").cast("double")
    ties = rows.groupBy(*keys, Q).agg(F.count("*").alias("_t")).groupBy(*keys).agg(F.sum(t).alias("n"), F.sum(t * (t - 1) * (2 * t + 5)).alias("_ties"))
    n = F.col("n")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18
    z = F.when(F.col("s") > 0, div(F.col("s") - 1, F.sqrt("var_s"))).when(F.col("s") < 0, div(F.col("s") + 1, F.sqrt("var_s"))).otherwise(0.0)
    rows = sums.join(ties, list(keys)).withColumn("var_s", variance).withColumn("z", z).withColumn("p_value", normal_tail(F.col("z")))
    rows = rows.withColumn("tau", div(F.col("s"), n * (n - 1) / 2))
    found = F.col("p_value") < alpha
    return rows.select(
        *keys, "s", "var_s", "z", "p_value", "tau", "sen_slope", found.alias("significant"),
        F.when(~found, "no trend").when(F.col("z") > 0, "increasing").otherwise("decreasing").alias("direction"),
    )


def seasonal_mann_kendall(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall of every calendar month's yearly means, their S and variances added up."""
    monthly = present(series).groupBy(KEY, F.month(TIME).alias("month"), F.year(TIME).alias("_y")).agg(F.avg(Q).alias(Q))
    monthly = monthly.select(KEY, "month", F.make_date("_y", F.lit(1), F.lit(1)).alias(TIME), Q)
    parts = mann_kendall(monthly, alpha, (KEY, "month"))
    rows = parts.groupBy(KEY).agg(F.sum("s").alias("s"), F.sum("var_s").alias("var_s"), F.median("sen_slope").alias("sen_slope"))
    z = F.when(F.col("s") > 0, div(F.col("s") - 1, F.sqrt("var_s"))).when(F.col("s") < 0, div(F.col("s") + 1, F.sqrt("var_s"))).otherwise(0.0)
    return rows.withColumn("z", z).select(KEY, "s", "var_s", "z", normal_tail(F.col("z")).alias("p_value"), "sen_slope")


def _enough(rows: DataFrame, least: int) -> DataFrame:
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(KEY))).where(F.col("_n") >= least)


def pettitt(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Largest |U_t|, where U_t = 2 * (sum of the first t ranks) - t * (n + 1), its p, and the row
    before the change; at least 10 rows."""
    rows = _enough(present(series), 10)
    tied = F.count("*").over(Window.partitionBy(KEY, Q))
    rank = F.rank().over(by(KEY, Q)) + (tied - 1) / 2
    rows = rows.withColumn("_r", rank).withColumn("_t", F.row_number().over(by(KEY, TIME)))
    rows = rows.withColumn("_u", F.abs(2 * F.sum("_r").over(by(KEY, TIME).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t") * (F.col("_n") + 1)))
    best = rows.where("_t < _n").groupBy(KEY).agg(F.max("_u").alias("kt_statistic"), F.max_by(F.struct("_t", TIME), F.struct(F.col("_u"), -F.col("_t"))).alias("_b"), F.first("_n").cast("double").alias("_n"))
    p = 2 * F.exp(-6 * F.pow("kt_statistic", F.lit(2)) / (F.pow("_n", F.lit(3)) + F.pow("_n", F.lit(2))))
    return best.select(KEY, "kt_statistic", (F.col("_b._t") - 1).alias("change_point_index"), F.col(f"_b.{TIME}").alias("change_date"), p.alias("p_value"), (p < alpha).alias("change_point_detected"))


def buishand(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Range of the cumulated anomalies over s * sqrt(n), against the published critical values."""
    rows = _enough(present(series), 10)
    mean = F.avg(Q).over(Window.partitionBy(KEY))
    rows = rows.withColumn("_a", F.col(Q) - mean)
    rows = rows.withColumn("_c", F.sum("_a").over(by(KEY, TIME).rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(KEY).agg(div(F.max("_c") - F.min("_c"), F.stddev_samp(Q) * F.sqrt(F.count("*"))).alias("q_statistic"), F.count("*").alias("_n"))
    large = {0.05: 1.747, 0.01: 2.05}.get(alpha, 1.96)
    critical = F.when(F.col("_n") >= 50, large).otherwise((1.4 if alpha == 0.05 else 1.6) + 0.3 * F.log10("_n"))
    return out.select(KEY, "q_statistic", critical.alias("critical_value"), (F.col("q_statistic") < critical).alias("homogeneous"))


def snht(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Standard normal homogeneity test: largest t * mean1**2 + (n - t) * mean2**2 of standard scores."""
    rows = _enough(present(series), 10)
    own = Window.partitionBy(KEY)
    rows = rows.withColumn("_z", div(F.col(Q) - F.avg(Q).over(own), F.stddev_samp(Q).over(own))).withColumn("_t", F.row_number().over(by(KEY, TIME)))
    rows = rows.withColumn("_s", F.sum("_z").over(by(KEY, TIME).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_z").over(own))
    t, n = F.col("_t"), F.col("_n")
    value = F.pow("_s", F.lit(2)) / t + div(F.pow(F.col("_all") - F.col("_s"), 2), n - t)
    rows = rows.where("_t < _n").withColumn("_v", value)
    best = rows.groupBy(KEY).agg(F.max("_v").alias("t_statistic"), F.max_by("_t", F.struct(F.col("_v"), -F.col("_t"))).alias("_i"))
    critical = {0.05: 8.45, 0.01: 10.5}.get(alpha, 9.0)
    return best.select(KEY, "t_statistic", F.lit(critical).alias("critical_value"), (F.col("_i") - 1).alias("change_point_index"), (F.col("t_statistic") > critical).alias("change_point_detected"))


def von_neumann(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Ratio of squared steps to squared anomalies, and its z."""
    rows = _enough(present(series), 10).withColumn("_d", F.col(Q) - F.lag(Q).over(by(KEY, TIME)))
    out = rows.groupBy(KEY).agg(div(F.sum(F.pow("_d", F.lit(2))), F.var_pop(Q) * F.count("*")).alias("von_neumann_ratio"), F.count("*").cast("double").alias("_n"))
    n = F.col("_n")
    z = (F.col("von_neumann_ratio") - 2) / F.sqrt(4 * (n - 2) / ((n + 1) * (n - 1)))
    return out.select(KEY, "von_neumann_ratio", z.alias("z_statistic"), normal_tail(z).alias("p_value"), (normal_tail(z) > alpha).alias("random"))


def runs(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Wald-Wolfowitz runs above the median, with the continuity correction."""
    rows = _enough(present(series), 10)
    middle = rows.groupBy(KEY).agg(F.median(Q).alias("_m"))
    rows = rows.join(middle, KEY).withColumn("_up", F.col(Q) > F.col("_m"))
    rows = rows.withColumn("_new", F.coalesce(F.col("_up") != F.lag("_up").over(by(KEY, TIME)), F.lit(True)))
    out = rows.groupBy(KEY).agg(F.count_if("_new").alias("runs"), F.count_if("_up").cast("double").alias("_a"), F.count_if(~F.col("_up")).cast("double").alias("_b"))
    a, b, n = F.col("_a"), F.col("_b"), F.col("_a") + F.col("_b")
    expected = 2 * a * b / n + 1
    spread = F.sqrt(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)))
    shift = F.when(F.col("runs") > expected, -0.5).otherwise(0.5)
    none = (a == 0) | (b == 0)
    z = F.when(none, 0.0).otherwise(F.coalesce(div(F.col("runs") + shift - expected, spread), F.lit(0.0)))
    p = F.when(none, 0.0).otherwise(normal_tail(z))
    return out.select(KEY, "runs", F.when(none, 0.0).otherwise(expected).alias("expected_runs"), z.alias("z_statistic"), p.alias("p_value"), (p > alpha).alias("random"))


def ljung_box(series: DataFrame, lags: int = 10) -> DataFrame:
    """n * (n + 2) * sum of r_k**2 / (n - k), r_k the correlation of the series with itself k rows on."""
    rows = _enough(present(series), lags + 5).withColumnRenamed(Q, "_x")
    rows = rows.select(KEY, "_x", *(F.lag("_x", k).over(by(KEY, TIME)).alias(f"_l{k}") for k in range(1, lags + 1)))
    n = F.count("*").cast("double")
    total = sum((F.pow(F.coalesce(pearson("_x", f"_l{k}"), F.lit(0.0)), 2) / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    return rows.groupBy(KEY).agg((n * (n + 2) * total).alias("lb_statistic")).withColumn("degrees_of_freedom", F.lit(lags))


def chi_square_p(rows: DataFrame, statistic: str = "lb_statistic", df: str = "degrees_of_freedom") -> DataFrame:
    """rows with p_value of a chi-square statistic."""

    def run(frames):
        for f in frames:
            f["p_value"] = [chi2_sf(x, k) for x, k in zip(f[statistic], f[df])]
            yield f

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", p_value double")


def homogeneity(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """All homogeneity tests; inhomogeneous if Pettitt or the SNHT finds a change or Buishand's range is too wide."""
    a = pettitt(series, alpha).select(KEY, "kt_statistic", F.col("change_point_detected").alias("pettitt_change"))
    b = buishand(series, alpha).select(KEY, "q_statistic", "homogeneous")
    c = snht(series, alpha).select(KEY, "t_statistic", F.col("change_point_detected").alias("snht_change"))
    d = von_neumann(series, alpha).select(KEY, "von_neumann_ratio")
    e = runs(series, alpha).select(KEY, "runs")
    rows = a.join(b, KEY).join(c, KEY).join(d, KEY).join(e, KEY).join(ljung_box(series).select(KEY, "lb_statistic"), KEY, "left")
    found = F.coalesce("pettitt_change", F.lit(False)) | ~F.coalesce("homogeneous", F.lit(True)) | F.coalesce("snht_change", F.lit(False))
    return rows.withColumn("inhomogeneity_detected", found)


def variance_changes(series: DataFrame, window: int = 50) -> DataFrame:
    """Rows where the centred variance over so many rows steps by more than its 95 % quantile."""
    rows = _enough(present(series), 2 * window)
    order = by(KEY, TIME)
    wide = order.rowsBetween(-(window // 2), (window - 1) // 2)
    rows = rows.select(KEY, TIME, F.row_number().over(order).alias("_i"), F.when(F.count("*").over(wide) == window, F.var_samp(Q).over(wide)).alias("_v"))
    rows = rows.select(KEY, TIME, (F.col("_i") - 1).alias("index"), F.abs(F.col("_v") - F.lag("_v").over(order)).alias("variance_change"))
    limit = rows.groupBy(KEY).agg(F.percentile("variance_change", F.lit(0.95)).alias("_limit"))
    return rows.join(limit, KEY).where("variance_change > _limit").drop("_limit")


_POINT = "gauge_id string, method string, index long, date date, score double"


def _kernel(series: DataFrame, find) -> DataFrame:
    """find(values) gives (index, score) of change points; one gauge's series at a time."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME)
        found = list(find(frame[Q].to_numpy(float)))
        at = [i for i, _, _ in found]
        return pd.DataFrame(
            {KEY: frame[KEY].iloc[0], "method": [m for _, m, _ in found], "index": at, "date": frame[TIME].iloc[at].to_numpy(), "score": [s for _, _, s in found]}
        )

    return present(series).groupBy(KEY).applyInPandas(run, _POINT)


def cusum_points(x: np.ndarray, threshold: float | None = None):
    """Indexes where the one-sided sums of anomalies pass the threshold (two standard deviations); both reset there."""
    if len(x) < 10:
        return
    limit, anomaly = 2 * x.std(ddof=1) if threshold is None else threshold, x - x.mean()
    up = down = 0.0
    for i in range(1, len(x)):
        up, down = max(0.0, up + anomaly[i]), min(0.0, down + anomaly[i])
        if up > limit or -down > limit:
            yield i, "cusum", up if up > limit else down
            up = down = 0.0


def binary_segmentation_points(x: np.ndarray, least: int = 10, most: int = 10):
    """Splits that leave the least within-segment variance, best first, then in order."""
    if len(x) < 2 * least:
        return
    s1, s2 = (np.concatenate(([0.0], np.cumsum(v))) for v in (x, x * x))

    def variance(a, b):
        n = b - a
        with np.errstate(divide="ignore", invalid="ignore"):
            return (s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / n) / (n - 1)

    def split(a, b):
        at = np.arange(a + least, b - least)
        whole = variance(a, b)
        if not len(at) or not whole > 0:
            return None, 0.0
        score = 1 - ((at - a) * variance(a, at) + (b - at) * variance(at, b)) / ((b - a) * whole)
        k = int(np.argmax(score))
        return (int(at[k]), float(score[k])) if score[k] > 0 else (None, 0.0)

    found, segments = [], [(0, len(x) - 1)]
    while segments and len(found) < most:
        options = [(*split(a, b), (a, b)) for a, b in segments if b - a >= 2 * least]
        best = max(options, key=lambda o: o[1], default=(None, 0.0, None))
        if best[0] is None:
            break
        at, score, (a, b) = best
        found.append((at, "binary_segmentation", score))
        segments.remove((a, b))
        segments += [s for s in ((a, at), (at, b)) if s[1] - s[0] >= least]
    yield from sorted(found)


def mean_shift_points(x: np.ndarray, least: int = 20, alpha: float = 0.01):
    """Splits whose pooled t-test has p below alpha; of those closer than least rows the smallest p stays."""
    n = len(x)
    if n < 2 * least:
        return
    at = np.arange(least, n - least)
    s1, s2 = np.cumsum(x), np.cumsum(x * x)
    m1, m2 = s1[at - 1] / at, (s1[-1] - s1[at - 1]) / (n - at)
    inner = s2[-1] - at * m1**2 - (n - at) * m2**2
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (m1 - m2) / np.sqrt(inner / (n - 2) * (1 / at + 1 / (n - at)))
    rows = [(t_two_sided(float(v), n - 2), int(i), float(v)) for i, v in zip(at, t) if np.isfinite(v)]
    kept: list[tuple] = []
    for p, i, v in sorted(r for r in rows if r[0] < alpha):
        if all(abs(i - k) >= least for _, k, _ in kept):
            kept.append((p, i, v))
    for _, i, v in sorted(kept, key=lambda r: r[1]):
        yield i, "mean_shift", v


DETECTORS = {"cusum": cusum_points, "binary_segmentation": binary_segmentation_points, "mean_shift": mean_shift_points}


def change_points(series: DataFrame, methods: tuple[str, ...] = ("cusum", "binary_segmentation", "variance", "mean_shift")) -> DataFrame:
    """(gauge_id, method, index, date, score) of all detectors asked for; series too short for one have none of it."""
    kernels = [DETECTORS[m] for m in methods if m != "variance"]
    out = _kernel(series, lambda x: [p for k in kernels for p in k(x)])
    if "variance" in methods:
        steps = variance_changes(series).select(KEY, F.lit("variance").alias("method"), F.col("index").cast("long"), TIME, F.col("variance_change").alias("score"))
        out = out.unionByName(steps)
    return out


def piecewise_trends(series: DataFrame, breaks: list[int]) -> DataFrame:
    """linear_trend of every segment between break years; a break year belongs to both sides."""
    edges = [-(2**31), *sorted(breaks), 2**31 - 1]
    segments = F.array(*(F.struct(F.lit(i).alias("segment"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))
    rows = present(series).withColumn("_s", F.explode(segments)).where(F.year(TIME).between(F.col("_s.a"), F.col("_s.b")))
    rows = rows.select(F.concat_ws("|", KEY, F.col("_s.segment").cast("string")).alias(KEY), TIME, Q)
    fit = linear_trend(rows)
    cut = F.split(F.reverse(KEY), r"\|", 2)
    return fit.select(F.reverse(F.get(cut, F.lit(1))).alias(KEY), F.reverse(F.get(cut, F.lit(0))).cast("int").alias("segment"), *fit.columns[1:])


def detected_breaks(series: DataFrame, most: int = 3, apart: int = 2) -> DataFrame:
    """(gauge_id, breaks): years in which the centred rolling variance (of a tenth of the rows, five at
    least) changes by more than nine tenths of its changes; years within `apart` of either end are
    left out, and only the first `most` stay."""

    def run(frame):
        frame = frame.sort_values(TIME)
        window = max(5, len(frame) // 10)
        change = frame[Q].rolling(window, center=True).var().diff().abs()
        years = pd.to_datetime(frame[TIME]).dt.year
        found = sorted(set(years[change > change.quantile(0.9)]))
        kept = [int(y) for y in found if years.iloc[0] + apart < y < years.iloc[-1] - apart]
        return pd.DataFrame({KEY: [frame[KEY].iloc[0]], "breaks": [kept[:most]]})

    return present(series).groupBy(KEY).applyInPandas(run, f"{KEY} string, breaks array<int>")


def broken_trends(series: DataFrame, breaks: DataFrame) -> DataFrame:
    """linear_trend of every segment between a gauge's own breaks (gauge_id, breaks), detected_breaks()
    for one; a break year belongs to both sides."""
    rows = present(series).join(breaks, KEY).withColumn("_y", F.year(TIME))
    before = F.size(F.filter("breaks", lambda b: b < F.col("_y")))
    twice = F.array_contains("breaks", F.col("_y"))
    rows = rows.withColumn("_s", F.explode(F.when(twice, F.array(before, before + 1)).otherwise(F.array(before))))
    fit = linear_trend(rows.select(F.concat_ws("|", KEY, F.col("_s").cast("string")).alias(KEY), TIME, Q))
    cut = F.split(F.reverse(KEY), r"\|", 2)
    return fit.select(F.reverse(F.get(cut, F.lit(1))).alias(KEY), F.reverse(F.get(cut, F.lit(0))).cast("int").alias("segment"), *fit.columns[1:])


def with_rank_p(rows: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Rank correlations with p_value, two-sided, from the t distribution."""

    def run(frames):
        for f in frames:
            out = []
            for r, k in zip(f[rho].to_numpy(float, na_value=np.nan), f[n]):
                known = not np.isnan(r) and k > 2
                out.append((0.0 if abs(r) >= 1 else t_two_sided(r * np.sqrt((k - 2) / (1 - r * r)), k - 2)) if known else None)
            f["p_value"] = out
            yield f

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", p_value double")
