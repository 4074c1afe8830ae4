"""Rainfall-runoff models over panels: baseflow, simulation, calibration by batches of parameter sets,
non-dominated sets and their selection, and forests.

A gauge's series is one group: a few thousand days. Calibration evaluates a whole design of parameter
sets in one pass over the days, keeps the best, and narrows the design around it; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import kernels
from freshet.functions.expr import div
from freshet.sources import files
from freshet.operators.signatures import KEY, Q, TIME, present

_BASEFLOW = "gauge_id string, date date, q double, baseflow double, bfi double"


def baseflow(series: DataFrame, alpha: float | None = None, passes: int = 3, reflect: int = 30, ensemble: int = 1000) -> DataFrame:
    """(gauge_id, date, q, baseflow, bfi) by the Lyne-Hollick filter: of one alpha, or averaged over an
    even grid of `ensemble` alphas from 0.9 to 0.98, the middles of as many equal steps."""
    if alpha is not None and not 0.9 <= alpha <= 0.98:
        raise ValueError("alpha lies between 0.9 and 0.98")
    alphas = np.array([alpha]) if alpha is not None else 0.9 + 0.08 * (np.arange(ensemble) + 0.5) / ensemble

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME)
        q = frame[Q].to_numpy(float)
        sums, index = np.zeros(len(q)), []
        for part in np.array_split(alphas, max(1, len(alphas) // 100)):
            bfi, base = kernels.lyne_hollick(q, part, passes, reflect)
            index.append(bfi)
            sums += base * len(part)
        return frame.assign(baseflow=sums / len(alphas), bfi=float(np.mean(np.concatenate(index))))[[KEY, TIME, Q, "baseflow", "bfi"]]

    return present(series).groupBy(KEY).applyInPandas(run, _BASEFLOW)


def baseflow_stats(series: DataFrame, **how) -> DataFrame:
    """The index, and mean, median, spread, extremes and share of the baseflow."""
    return baseflow(series, **how).groupBy(KEY).agg(
        F.first("bfi").alias("bfi"), F.avg("baseflow").alias("baseflow_mean"), F.median("baseflow").alias("baseflow_median"),
        F.stddev_pop("baseflow").alias("baseflow_std"), F.min("baseflow").alias("baseflow_min"), F.max("baseflow").alias("baseflow_max"),
        div(F.stddev_pop("baseflow"), F.avg("baseflow")).alias("baseflow_cv"), F.avg(F.col(Q) - F.col("baseflow")).alias("quickflow_mean"),
    )


def bounds(model: str) -> list[tuple[float, float]]:
    """Parameter bounds of gr4j (with snow: 7) or hbv (16)."""
    return [*kernels.GR4J_BOUNDS, *kernels.SNOW_BOUNDS] if model == "gr4j" else kernels.HBV_BOUNDS


def simulate_frame(model: str, frame: pd.DataFrame, params: np.ndarray) -> np.ndarray:
    """Flow [days, sets] over a frame sorted by date with prcp, pet and t_mean."""
    temp, rain, pet = (frame[c].to_numpy(float) for c in ("t_mean", "prcp", "pet"))
    when = pd.to_datetime(frame[TIME])
    if model == "hbv":
        return kernels.hbv(temp, rain, pet, when.dt.dayofyear.to_numpy(), params)
    if params.shape[1] >= 7:
        rain, _ = kernels.cema_neige(temp, rain, when.dt.year.to_numpy(), params[:, 4:7])
    return kernels.gr4j(rain, pet, params[:, :4])


def simulate(forcing: DataFrame, params: DataFrame, model: str = "gr4j") -> DataFrame:
    """(gauge_id, date, q_obs, q_sim). forcing: gauge_id, date, prcp, pet, t_mean, q; params: gauge_id,
    params array<double>."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME)
        sim = simulate_frame(model, frame, np.array([frame["params"].iloc[0]], float))[:, 0]
        return pd.DataFrame({KEY: frame[KEY], TIME: frame[TIME], "q_obs": frame[Q], "q_sim": sim})

    rows = forcing.join(params.select(KEY, "params"), KEY)
    return rows.groupBy(KEY).applyInPandas(run, "gauge_id string, date date, q_obs double, q_sim double")


def design(limits: list[tuple[float, float]], n: int, draw: np.random.Generator) -> np.ndarray:
    """Latin hypercube: every parameter's range in n equal steps, each hit once."""
    low, high = np.array(limits).T
    steps = np.array([draw.permutation(n) for _ in limits]).T
    return low + (steps + draw.random(steps.shape)) / n * (high - low)


def scores(obs: np.ndarray, sim: np.ndarray) -> dict[str, np.ndarray]:
    """KGE, NSE, logNSE and PBIAS of sim [days, sets]; -999 where undefined."""
    use = np.isfinite(obs)
    obs, sim = obs[use, None], sim[use]
    with np.errstate(all="ignore"):
        def nse(o, s):
            return 1 - ((o - s) ** 2).sum(axis=0) / ((o - o.mean()) ** 2).sum()

        do, ds = obs - obs.mean(), sim - sim.mean(axis=0)
        r = (do * ds).sum(axis=0) / np.sqrt((do**2).sum() * (ds**2).sum(axis=0))
        alpha, beta = np.clip(sim.std(axis=0) / obs.std(), 0, 1e6), np.clip(sim.mean(axis=0) / obs.mean(), 0, 1e6)
        kge = 1 - np.sqrt((np.nan_to_num(r) - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2)
        log = nse(np.log(np.maximum(obs, 0) + 0.01), np.log(np.maximum(sim, 0) + 0.01))
        bias = 100 * (sim - obs).sum(axis=0) / obs.sum()
        found = {"KGE": kge, "NSE": nse(obs, sim), "logNSE": log, "neg_PBIAS": -np.abs(bias)}
    return {k: np.where(np.isfinite(v), v, -999.0) for k, v in found.items()}


def calibrate(forcing: DataFrame, model: str = "gr4j", warmup_days: int = 365, sets: int = 50, rounds: int = 20, seed: int = 42, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """(keys, trial, params, KGE, NSE, logNSE, neg_PBIAS) of every set tried: differential evolution
    towards KGE, one generation of `sets` a round, the first a Latin hypercube over the bounds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME)
        obs, draw, limits, out = frame[Q].to_numpy(float)[warmup_days:], np.random.default_rng(seed), bounds(model), []
        low, high = np.array(limits).T

        def tried(params: np.ndarray) -> np.ndarray:
            found = scores(obs, simulate_frame(model, frame, params)[warmup_days:])
            out.append(pd.DataFrame({"params": list(params), **found}))
            return found["KGE"]

        kept = design(limits, sets, draw)
        value = tried(kept)
        for _ in range(rounds - 1):
            best, step = kept[int(value.argmax())], draw.uniform(0.4, 0.9, (sets, 1))
            moved = kept + step * (best - kept) + step * (kept[draw.permutation(sets)] - kept[draw.permutation(sets)])
            moved = np.where(draw.random(kept.shape) < 0.9, np.clip(moved, low, high), kept)
            new = tried(moved)
            better = new > value
            kept[better], value[better] = moved[better], new[better]
        rows = pd.concat(out, ignore_index=True)
        rows.insert(0, "trial", np.arange(len(rows)))
        for k in reversed(keys):
            rows.insert(0, k, frame[k].iloc[0])
        return rows

    schema = ", ".join(f"{k} string" for k in keys) + ", trial int, params array<double>, KGE double, NSE double, logNSE double, neg_PBIAS double"
    return forcing.groupBy(*keys).applyInPandas(run, schema)


def best_trials(trials: DataFrame, objective: str = "KGE", keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The trial of each group with the highest objective; the first of equals."""
    first = F.max_by(F.struct("*"), F.struct(F.col(objective), -F.col("trial")))
    return trials.groupBy(*keys).agg(first.alias("_b")).select("_b.*")


def fitted(forcing: DataFrame, split: str, path: str, model: str = "gr4j", warmup_years: int = 2, **how) -> DataFrame:
    """Calibrate on the days before split, validate on the rest, save both: (gauge_id, params, KGE, NSE,
    logNSE, neg_PBIAS) of the validation, whose simulation begins warmup_years earlier and is scored
    from split on. Writes <path>/params and <path>/metrics as JSON, the first for predict()."""
    early = F.col(TIME) < F.lit(split).cast("date")
    best = best_trials(calibrate(forcing.where(early), model, **how)).select(KEY, "params")
    files.write(best, f"{path}/params", "json")
    sim = predict(warmup_slice(forcing, split, warmup_years), path, model).where(~early)
    files.write(validated(sim), f"{path}/metrics", "json")
    spark = forcing.sparkSession
    metrics = spark.read.schema(f"{KEY} string, " + ", ".join(f"{m} double" for m in METRICS)).json(f"{path}/metrics")
    return saved_params(spark, path).join(metrics, KEY)


def saved_params(spark, path: str) -> DataFrame:
    """(gauge_id, params) that fitted() wrote."""
    return spark.read.schema(f"{KEY} string, params array<double>").json(f"{path}/params")


def predict(forcing: DataFrame, path: str, model: str = "gr4j", start: str | None = None, warmup_years: int = 2) -> DataFrame:
    """(gauge_id, date, q_obs, q_sim) with the parameters saved at path; start: simulate from
    warmup_years before it on, and return what follows it."""
    rows = forcing if start is None else warmup_slice(forcing, start, warmup_years)
    sim = simulate(rows, saved_params(forcing.sparkSession, path), model)
    return sim if start is None else sim.where(F.col(TIME) >= F.lit(start).cast("date"))


#: Scores of a simulation.
METRICS = ("KGE", "NSE", "logNSE", "neg_PBIAS")


def validated(sim: DataFrame) -> DataFrame:
    """(gauge_id, KGE, NSE, logNSE, neg_PBIAS) of q_sim against q_obs: the scores of the calibration."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = scores(frame["q_obs"].to_numpy(float), frame["q_sim"].to_numpy(float)[:, None])
        return pd.DataFrame({KEY: [frame[KEY].iloc[0]], **{m: found[m] for m in METRICS}})

    return sim.groupBy(KEY).applyInPandas(run, f"{KEY} string, " + ", ".join(f"{m} double" for m in METRICS))


def leave_one_basin_out(features: DataFrame, columns: list[str], basins: list[str], target: str = "q", **how) -> DataFrame:
    """(gauge_id, date, q, q_sim) of every basin of basins, predicted by a forest of all other gauges: one
    forest a basin, so basins are a list that the caller bounds."""
    parts = []
    for basin in basins:
        model = forest(features.where(F.col(KEY) != basin), columns, target, **how)
        parts.append(predicted(model, features.where(F.col(KEY) == basin), columns).select(KEY, TIME, target, "q_sim"))
    return reduce(DataFrame.unionByName, parts)


def pareto_front(trials: DataFrame, objectives: list[str], keys: list[str]) -> DataFrame:
    """Trials that no other of their group dominates: as good in every objective and better in one."""
    names = {o: f"_o_{o}" for o in objectives}
    others = trials.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(o).alias(n) for o, n in names.items()))
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    no_worse = [F.col(n) >= F.col(o) for o, n in names.items()]
    better = F.lit(False)
    for o, n in names.items():
        better = better | (F.col(n) > F.col(o))
    condition = better
    for c in (*same, *no_worse):
        condition = condition & c
    return trials.join(others, condition, "left_anti")


def selected(front: DataFrame, weights: dict[str, float], keys: list[str], method: str = "weighted_sum", order: str = "trial") -> DataFrame:
    """One trial of each group: by weighted sum, closeness to the ideal (topsis) or weighted distance from
    it (compromise). The first of equals."""
    w = Window.partitionBy(*keys)
    if method == "weighted_sum":
        score = sum((F.col(o) * x for o, x in weights.items()), F.lit(0.0))
    elif method == "topsis":
        scaled = {o: div(F.col(o), F.sqrt(F.sum(F.pow(F.col(o), 2)).over(w))) * x for o, x in weights.items()}
        rows = front.select("*", *(v.alias(f"_v_{o}") for o, v in scaled.items()))
        front = rows.select("*", *(f(f"_v_{o}").over(w).alias(f"_{n}_{o}") for o in weights for n, f in (("hi", F.max), ("lo", F.min))))
        far = lambda n: F.sqrt(sum((F.pow(F.col(f"_v_{o}") - F.col(f"_{n}_{o}"), 2) for o in weights), F.lit(0.0)))
        score = F.coalesce(div(far("lo"), far("hi") + far("lo")), F.lit(0.0))
    elif method == "compromise":
        span = lambda o: (F.col(o) - F.min(o).over(w)) / (F.max(o).over(w) - F.min(o).over(w) + 1e-10)
        score = -F.sqrt(sum((x * F.pow(1 - span(o), 2) for o, x in weights.items()), F.lit(0.0)))
    else:
        raise ValueError(f"unknown method {method}")
    rows = front.withColumn("selection_score", score)
    first = F.row_number().over(w.orderBy(F.desc("selection_score"), order))
    keep = [c for c in rows.columns if not c.startswith(("_v_", "_hi_", "_lo_"))]
    return rows.withColumn("_first", first).where("_first = 1").select(*keep)


def forest(features: DataFrame, columns: list[str], target: str = "q", trees: int = 50, depth: int = 10, seed: int = 42):
    """A random forest over the rows without nulls: a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = features.na.drop(subset=[*columns, target])
    steps = [VectorAssembler(inputCols=columns, outputCol="_x"), RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def predicted(model, features: DataFrame, columns: list[str]) -> DataFrame:
    """features with q_sim, the forest's prediction, not below zero."""
    out = model.transform(features.na.drop(subset=columns))
    return out.withColumn("q_sim", F.greatest(F.lit(0.0), F.col("prediction"))).drop("_x", "prediction")


def warmup_slice(rows: DataFrame, start, years: int) -> DataFrame:
    """Rows from so many years before the start date on; what there is of them."""
    return rows.where(F.col(TIME) >= F.add_months(F.lit(start).cast("date"), -12 * years))


def best_epoch(scores_: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "NSE") -> DataFrame:
    """(run, epoch, median): the epoch with the highest median score; the first of equals."""
    medians = scores_.groupBy(run, epoch).agg(F.median(score).alias("median"))
    return medians.groupBy(run).agg(F.max_by(epoch, F.struct(F.col("median"), -F.col(epoch))).alias(epoch), F.max("median").alias("median"))


def cell_correlations(states: DataFrame, processes: DataFrame, names: list[str], least: int = 30) -> DataFrame:
    """(gauge_id, cell, process, r): correlation of every cell of a state array (gauge_id, date, h) with
    every process column, over least rows or more."""
    from freshet.functions.expr import pearson

    cells = states.select(KEY, TIME, F.posexplode("h").alias("cell", "_h")).join(processes, [KEY, TIME])
    wide = cells.groupBy(KEY, "cell").agg(*(F.when(F.count(F.col(n)) >= least, pearson("_h", n)).alias(n) for n in names))
    return wide.unpivot([KEY, "cell"], names, "process", "r")
