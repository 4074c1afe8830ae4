"""Model skill: scores of simulated against observed flow, one row per group of keys.

Pairs with a missing side are left out. A score that the data don't define is null. Everything is
partial-aggregated in one pass; scores with thresholds of the group join these back first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.expr import col, div, pearson, quantile

O, S = "obs", "sim"
EPSILON = 0.01
BANDS = ["very_low", "low", "medium", "high", "very_high"]
#: Score that stands for a simulation that cannot be scored.
INVALID = -999.0


def both(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col(O).isNotNull() & F.col(S).isNotNull() & ~F.isnan(O) & ~F.isnan(S))


def nse(o: Column | str = O, s: Column | str = S) -> Column:
    """Nash-Sutcliffe efficiency."""
    return 1 - div(F.sum(F.pow(col(o) - col(s), 2)), F.var_pop(col(o)) * F.count(col(o)))


def kge(o: Column | str = O, s: Column | str = S) -> Column:
    """Kling-Gupta efficiency; INVALID where a simulated value is infinite or beyond a million."""
    o, s = col(o), col(s)
    r = F.coalesce(pearson(o, s), F.lit(0.0))
    limit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1e6), x))
    alpha, beta = limit(div(F.stddev_pop(s), F.stddev_pop(o))), limit(div(F.avg(s), F.avg(o)))
    score = 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2))
    known = (F.avg(o) != 0) & (F.stddev_pop(o) != 0)
    return F.when(F.max(F.abs(s)) > 1e6, INVALID).when(known, score)


def pbias(o: Column | str = O, s: Column | str = S) -> Column:
    return div(100 * F.sum(col(s) - col(o)), F.sum(col(o)))


def rmse(o: Column | str = O, s: Column | str = S) -> Column:
    return F.sqrt(F.avg(F.pow(col(s) - col(o), 2)))


def mae(o: Column | str = O, s: Column | str = S) -> Column:
    return F.avg(F.abs(col(s) - col(o)))


def log_nse() -> Column:
    fine = (F.min(O) > 0) & (F.min(S) > 0)
    safe = lambda x: F.ln(F.greatest(F.col(x), F.lit(0.0)) + EPSILON)
    return F.when(fine, nse(safe(O), safe(S)))


def inverse_nse() -> Column:
    return nse(div(F.lit(1.0), F.col(O) + EPSILON), div(F.lit(1.0), F.col(S) + EPSILON))


def sqrt_nse() -> Column:
    root = lambda x: F.sqrt(F.greatest(F.col(x), F.lit(0.0)))
    return F.when((F.min(O) >= 0) & (F.min(S) >= 0), nse(root(O), root(S)))


def _with(pairs: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    rows = both(pairs)
    return rows.join(rows.groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items())), keys)


def peak_flow_error(at: str = "_peak") -> Column:
    """Mean error in percent over the observations at or above the column's threshold."""
    high = F.col(O) >= F.col(at)
    return div(100 * F.sum(F.when(high, F.col(S) - F.col(O))), F.sum(F.when(high, F.col(O))))


def evaluate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """NSE, KGE, PBIAS, RMSE, MAE, logNSE, R2, r and PFE."""
    return _with(pairs, keys, _peak=quantile(O, 0.95)).groupBy(*keys).agg(
        nse().alias("NSE"), kge().alias("KGE"), pbias().alias("PBIAS"), rmse().alias("RMSE"), mae().alias("MAE"),
        log_nse().alias("logNSE"), F.pow(pearson(O, S), 2).alias("R2"), pearson(O, S).alias("r"), peak_flow_error().alias("PFE"),
    )


def enhanced(pairs: DataFrame, keys: list[str], low: tuple[float, float] = (0.5, 0.5), high: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Scores of transformed flows and the low- and high-flow composites. The high-flow composite takes
    the signed peak error off, so under-prediction of peaks raises it, as published."""
    if abs(sum(low) - 1) > 1e-8 or abs(sum(high) - 1) > 1e-8:
        raise ValueError("weights must sum to 1")
    rows = _with(pairs, keys, _peak=quantile(O, 0.95)).groupBy(*keys).agg(
        inverse_nse().alias("invNSE"), sqrt_nse().alias("sqrtNSE"), log_nse().alias("logNSE"), nse().alias("NSE"), peak_flow_error().alias("PFE")
    )
    both_low = low[0] * F.col("logNSE") + low[1] * F.col("invNSE")
    error = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("PFE") / 100))
    both_high = high[0] * F.col("NSE") - high[1] * error
    return rows.select(
        *keys, "invNSE", "sqrtNSE", F.coalesce(both_low, "logNSE", "invNSE").alias("composite_low"),
        F.when(F.col("NSE").isNotNull(), F.when(F.col("PFE").isNull(), F.col("NSE")).otherwise(both_high)).alias("composite_high"),
    )


def quantile_nse(pairs: DataFrame, keys: list[str], lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """NSE over the observations between two of their quantiles."""
    rows = _with(pairs, keys, _lo=quantile(O, lower), _hi=quantile(O, upper))
    return rows.where(F.col(O).between(F.col("_lo"), F.col("_hi"))).groupBy(*keys).agg(nse().alias("quantile_nse"))


def flow_bands(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """NSE and bias in five bands of observed flow (cut at the 10, 30, 70 and 90 % quantiles), and overall."""
    rows = _with(pairs, keys, _a=quantile(O, 0.1), _b=quantile(O, 0.3), _c=quantile(O, 0.7), _d=quantile(O, 0.9))
    o = F.col(O)
    band = F.when(o <= F.col("_a"), 0).when(o <= F.col("_b"), 1).when(o <= F.col("_c"), 2).when(o <= F.col("_d"), 3).otherwise(4)
    rows, out = rows.withColumn("_band", band), []
    for i, name in enumerate(BANDS):
        x, y = (F.when(F.col("_band") == i, F.col(c)) for c in (O, S))
        out += [nse(x, y).alias(f"{name}_nse"), pbias(x, y).alias(f"{name}_pbias")]
    return rows.groupBy(*keys).agg(*out, nse().alias("overall_nse"), kge().alias("overall_kge"), pbias().alias("overall_pbias"))


def _grade(value: Column, cuts: list[float], rising: bool) -> Column:
    """3 to 0; cuts from the best grade's to the worst's."""
    out = F.lit(0)
    for grade, cut in reversed(list(zip((3, 2, 1), cuts))):
        out = F.when(value > cut if rising else value <= cut, grade).otherwise(out)
    return F.coalesce(F.when(value.isNotNull(), out), F.lit(0)).cast("int")


def _composite(score: Column) -> Column:
    return F.when(score < 0.5, 0).when(score < 1.5, 1).when(score < 2.5, 2).otherwise(3)


def quality_grades(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Grades 0 to 3 of NSE, absolute bias and 1 - SSres / SStot, and of their mean; fewer than 3 pairs grade 0."""
    rows = both(pairs).groupBy(*keys).agg(F.count("*").alias("_n"), nse().alias("NSE"), pbias().alias("PBIAS"))
    enough = F.col("_n") >= 3
    rows = rows.select(*keys, "_n", *(F.when(enough, F.col(c)).alias(c) for c in ("NSE", "PBIAS"))).withColumn("R2", F.col("NSE"))
    grades = {
        "NSE_grade": _grade(F.col("NSE"), [0.8, 0.7, 0.5], True), "PBIAS_grade": _grade(F.abs("PBIAS"), [10, 15, 35], False),
        "R2_grade": _grade(F.col("R2"), [0.85, 0.7, 0.5], True),
    }
    score = sum(grades.values(), F.lit(0.0)) / 3
    return rows.select(
        *keys, "NSE", grades["NSE_grade"].alias("NSE_grade"), "PBIAS", grades["PBIAS_grade"].alias("PBIAS_grade"), "R2",
        grades["R2_grade"].alias("R2_grade"), score.alias("composite_score"), _composite(score).alias("composite_grade"),
    )


def best_model(scores: DataFrame, keys: list[str], score: str = "composite_score", tie: str = "NSE", name: str = "model") -> DataFrame:
    """The row of each group with the highest score; ties by the second score, then by name."""
    first = F.max_by(F.struct("*"), F.struct(score, tie, name))
    return scores.groupBy(*keys).agg(first.alias("_b")).select("_b.*")


def percentage_error(o: Column | str, s: Column | str, epsilon: float) -> Column:
    """Error in percent, or the plain difference where the observation is nearly zero."""
    o, s = col(o), col(s)
    return F.when(F.abs(o) < epsilon, s - o).otherwise(div((s - o) * 100, o))


def signature_errors(pairs: DataFrame, keys: list[str], baseflow: DataFrame | None = None) -> DataFrame:
    """Errors and grades of mean, high (5 % exceeded) and low (95 %) flow, and of the baseflow index
    where baseflow (keys, obs_bfi, sim_bfi) is given."""
    rows = pairs.groupBy(*keys).agg(
        F.avg(O).alias("obs_mean"), quantile(O, 0.95).alias("obs_q5"), quantile(O, 0.05).alias("obs_q95"),
        F.avg(S).alias("sim_mean"), quantile(S, 0.95).alias("sim_q5"), quantile(S, 0.05).alias("sim_q95"),
    )
    parts = {"mean": (0.01, [5, 10, 25], "mean_flow"), "q5": (0.1, [15, 25, 50], "q5"), "q95": (0.01, [20, 35, 60], "q95")}
    if baseflow is not None:
        rows = rows.join(baseflow, keys, "left")
        parts["bfi"] = (0.001, [10, 20, 40], "bfi")
    errors = {k: percentage_error(f"obs_{k}", f"sim_{k}", eps) for k, (eps, _, _) in parts.items()}
    grades = {name: _grade(F.abs(errors[k]), cuts, False) for k, (_, cuts, name) in parts.items()}
    score = sum(grades.values(), F.lit(0.0)) / 4
    return rows.select(
        *rows.columns, *(e.alias(f"{k}_error_pct") for k, e in errors.items()), *(g.alias(f"{n}_grade") for n, g in grades.items()),
        score.alias("signature_composite_score"), _composite(score).cast("int").alias("signature_composite_grade"),
    )


def generalization_gap(pairs: DataFrame, keys: list[str], split, least_rows: int = 30) -> DataFrame:
    """NSE before and from the split date, and their difference, where both periods have least_rows pairs."""
    rows = both(pairs)
    early = F.col("date") < F.lit(split).cast("date")
    out = {}
    for name, inside in (("train", early), ("test", ~early)):
        x, y = F.when(inside, F.col(O)), F.when(inside, F.col(S))
        out[name] = F.when(F.count(x) >= least_rows, nse(x, y))
    rows = rows.groupBy(*keys).agg(out["train"].alias("train_nse"), out["test"].alias("test_nse"))
    delta = F.col("test_nse") - F.col("train_nse")
    return rows.select(*keys, "train_nse", "test_nse", delta.alias("delta_nse"), (delta < 0).alias("degraded"))


def spearman(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Rank correlation, ties at their average rank."""
    from pyspark.sql import Window

    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = []
    for c in (x, y):
        tied = F.count("*").over(Window.partitionBy(*keys, c))
        ranks.append((F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (tied - 1) / 2).alias(f"_r_{c}"))
    return own.select(*keys, *ranks).groupBy(*keys).agg(pearson(f"_r_{x}", f"_r_{y}").alias("rho"), F.count("*").alias("n"))


def mann_whitney(rows: DataFrame, group: str, value: str) -> DataFrame:
    """U of the values where group is true against those where it is false, its normal z with the tie
    correction, and the counts."""
    from pyspark.sql import Window

    own = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        F.count_if(F.col(group)).alias("a"), F.count_if(~F.col(group)).alias("b")
    )
    below = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # one row per distinct value: the values of one table, not of the panel
    part = own.withColumn("less", F.coalesce(F.sum("b").over(below), F.lit(0)))
    t = F.col("a") + F.col("b")
    total = part.agg(
        F.sum(F.col("a") * (F.col("less") + F.col("b") / 2)).alias("u"), F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"),
        F.sum(F.pow(t, 3) - t).alias("_t"),
    )
    n = F.col("n1") + F.col("n2")
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - div(F.col("_t"), n * (n - 1))))
    return total.select("u", "n1", "n2", div(F.col("u") - F.col("n1") * F.col("n2") / 2, spread).alias("z"))
