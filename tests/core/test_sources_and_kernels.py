"""Histories that break off, files, and kernels against plain recursions."""

import datetime
import json
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import kernels
from freshet.operators import clusters, models, reports, signatures, spatial
from freshet.plans import catalog, panels
from freshet.sources import files
from freshet.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows_of(spark, days, value):
    return spark.createDataFrame([("a", datetime.date(2020, 1, d), value, 1) for d in days], "gauge_id string, date date, level double, n long")


def test_history_survives_a_broken_merge(spark, tmp_path):
    path = str(tmp_path / "history")
    assert ingest.read_history(spark, path) is None
    ingest.merge_history(spark, rows_of(spark, [1, 2], 1.0), path)
    # a merge that broke off while writing: files without the mark of a complete version
    os.makedirs(f"{path}/v2")
    with open(f"{path}/v2/part-0.parquet", "wb") as file:
        file.write(b"half a file")
    assert ingest.current(spark, path) == 1 and ingest.read_history(spark, path).count() == 2
    for turn, days in enumerate(([2, 3], [4], [1, 5])):
        ingest.merge_history(spark, rows_of(spark, days, 10.0 + turn), path)
    got = {r.date.day: r.level for r in ingest.read_history(spark, path).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 10.0, 4: 11.0, 5: 12.0}
    assert ingest.versions(spark, path) == [3, 4]


def lyne_hollick(q, alpha, reflect=30):
    """Three passes over a mirrored series, day by day."""
    mirrored = len(q) - 1 > reflect
    x = [*q[reflect:0:-1], *q, *q[-2 : -reflect - 2 : -1]] if mirrored else list(q)
    for turn in range(3):
        x = x[::-1] if turn == 1 else x
        quick, base = x[0], [x[0] - x[0] if x[0] >= 0 else x[0]]
        for a, b in zip(x, x[1:]):
            quick = alpha * quick + 0.5 * (1 + alpha) * (b - a)
            base.append(b - quick if quick >= 0 else b)
        x = base[::-1] if turn == 1 else base
    x = x[reflect:-reflect] if mirrored else x
    return [max(v, 0.0) for v in x]


def test_baseflow_index_against_a_plain_recursion(spark):
    draw = random.Random(1)
    series = {g: [abs(5 + 3 * math.sin(i / 20) + draw.gauss(0, 1)) for i in range(n)] for g, n in (("a", 400), ("b", 40), ("c", 12))}
    day = datetime.date(2001, 1, 1)
    df = spark.createDataFrame([(g, day + datetime.timedelta(i), q) for g, x in series.items() for i, q in enumerate(x)], "gauge_id string, date date, q double")
    one = {r.gauge_id: r.baseflow_index for r in signatures.baseflow_index(df, alpha=0.925).collect()}
    many = {r.gauge_id: r.baseflow_index for r in signatures.baseflow_index(df).collect()}
    for g, q in series.items():
        assert abs(one[g] - sum(lyne_hollick(q, 0.925)) / sum(q)) < 1e-9
        grid = [sum(lyne_hollick(q, 0.9 + 0.08 * (i + 0.5) / 1000)) / sum(q) for i in range(12, 1000, 25)]
        assert abs(many[g] - sum(grid) / len(grid)) < 2e-3
    base = {(r.gauge_id, r.date): r.baseflow for r in models.baseflow(df, 0.925).collect()}
    for g, q in series.items():
        assert all(abs(base[g, day + datetime.timedelta(i)] - v) < 1e-9 for i, v in enumerate(lyne_hollick(q, 0.925)))


def test_fifteen_period_metrics(spark):
    rows = signatures.period_metrics(panels.flow(spark, SF))
    assert len(rows.columns) == 2 + 15 and "baseflow_index" in rows.columns
    base = signatures.period_metrics(panels.flow(spark, SF), baseflow=False)
    assert base.columns == [c for c in rows.columns if c != "baseflow_index"]
    shares = [r.baseflow_index for r in rows.where("baseflow_index is not null").collect()]
    assert shares and all(0 <= x <= 1.5 for x in shares)


def test_unions_are_their_parts(spark):
    """The extreme, timing and variability unions hold the values of the blocks that SQL confirms."""
    flow = panels.flag_flow(spark, SF)
    cases = [
        (signatures.extreme_metrics, [signatures.flow_quantiles, signatures.high_flows, signatures.low_flows, signatures.drought_indices, signatures.flood_indices]),
        (signatures.variability_metrics, [signatures.basic_statistics, signatures.temporal_variability, signatures.autocorrelation, signatures.flashiness, signatures.seasonal_variability, signatures.interannual_variability]),
    ]
    for union, parts in cases:
        whole = {r.gauge_id: r.asDict() for r in union(flow).collect()}
        seen = {"gauge_id"}
        for part in parts:
            for r in part(flow).collect():
                for name, value in r.asDict().items():
                    seen.add(name)
                    assert whole[r.gauge_id][name] == value or abs(whole[r.gauge_id][name] - value) < 1e-9
        assert set(next(iter(whole.values()))) == seen


def test_principal_components(spark):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).collect()
    x = np.array([r.x for r in points])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    axes = axes[:2] * np.sign(axes[:2][np.arange(2), np.abs(axes[:2]).argmax(axis=1)])[:, None]
    expected = dict(zip([r.vec_id for r in points], x @ axes.T))
    for r in catalog.QUERIES["clus_principal"](spark, SF).collect():
        assert np.allclose([r["first"], r["second"]], expected[r.vec_id], atol=1e-5)


def test_merged_regions_end_at_their_target(spark):
    hexes = spark.createDataFrame([(q, r, f"L{(q * 7 + r * 3) % 17}") for q in range(12) for r in range(12)], "q long, r long, label string")
    for target in (6, 3):
        got = spatial.merged_regions(hexes, target)
        assert got.count() == 144 and got.select("merged").distinct().count() >= target
        assert got.select("merged").distinct().count() <= target + 1


def test_attributes_of_unknown_gauges_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gauge_id,area\n01,5.5\n02,x\n")
    path, known = str(tmp_path / "a.csv"), spark.createDataFrame([("01",), ("02",)], "gauge_id string")
    rows = {r.gauge_id: r.area for r in files.read_attributes(spark, path, known).collect()}
    assert rows == {"01": 5.5, "02": None}
    with pytest.raises(KeyError, match="03"):
        files.read_attributes(spark, path, known.union(spark.createDataFrame([("03",)], "gauge_id string")))


def test_unfinished_tasks_and_metrics(spark, tmp_path):
    for name, text in (("1_era_metrics.json", {"NSE": 0.5}), ("2_era_x_metrics.json", {"NSE": 0.25})):
        (tmp_path / name).write_text(json.dumps(text))
    (tmp_path / "3_era_metrics.json").write_text("no json")
    found = files.read_metrics(spark, str(tmp_path), ["NSE"])
    assert sorted(map(tuple, found.collect())) == [("1", "era", 0.5), ("2", "era_x", 0.25)]
    tasks = spark.createDataFrame([("1",), ("3",)], "gauge_id string")
    assert [r.gauge_id for r in files.unfinished(tasks, found, ["gauge_id"]).collect()] == ["3"]


def test_areas_extents_and_warm_up(spark):
    one = spark.createDataFrame([(1,)], "i int")
    hexagon_step = one.select(spatial.snapped(F.lit(12.3456), 0.25, False).alias("a"), spatial.snapped(F.lit(12.3456), 0.25, True).alias("b")).first()
    assert tuple(hexagon_step) == (12.34, 12.35)
    rows = spark.createDataFrame([(datetime.date(2000 + y, 6, 1),) for y in range(10)], "date date")
    assert models.warmup_slice(rows, "2005-01-01", 2).count() == 7
    assert reports.extremes(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None)], "gauge_id string, x double"), "x", 5, "gauge_id").count() == 2


def test_calibrate_validate_predict(spark, tmp_path):
    from freshet.plans import domain_queries

    forcing = domain_queries._forcing(spark, SF).where("gauge_id <> 'R'")
    path = str(tmp_path / "run")
    found = {r.gauge_id: r for r in models.fitted(forcing, "1996-01-01", path, sets=20, rounds=3).collect()}
    assert set(found) == {"A", "N"}
    sim = models.predict(forcing, path, start="1996-01-01", warmup_years=2).toPandas()
    assert str(sim["date"].min()) >= "1996-01-01"
    for gauge, rows in sim.groupby("gauge_id"):
        again = models.scores(rows["q_obs"].to_numpy(float), rows["q_sim"].to_numpy(float)[:, None])
        assert found[gauge].KGE == pytest.approx(again["KGE"][0]) and found[gauge].NSE == pytest.approx(again["NSE"][0])
        assert len(found[gauge].params) == 7


def test_kmeans_and_blocks_of_silhouettes(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(c, 0.2, (30, 3)) for c in (0, 4, 9)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    labels = clusters.kmeans(points, 3, "vec_id")
    assert [r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()] == [30, 30, 30]
    one, many = ({r.vec_id: r.silhouette for r in clusters.silhouettes(labels, "vec_id", block=b).collect()} for b in (20_000, 17))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)
    scan = {r.k: r.mean for r in clusters.kmeans_scan(points, range(2, 5), "vec_id").collect()}
    assert max(scan, key=scan.get) == 3
    places = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 2.0)], "vec_id long, lat double, lon double")
    assert [r.x[3:] for r in clusters.located_patterns(points, places, "x", "vec_id").collect()] == [[1.0, 2.0]]


def test_breaks_and_rank_p(spark):
    import pandas as pd

    from freshet.operators import statistics

    day, draw = datetime.date(2000, 1, 1), np.random.default_rng(6)
    x = np.concatenate((draw.normal(5, 0.1, 1500), draw.normal(5, 3, 1500)))
    df = spark.createDataFrame([("a|b", day + datetime.timedelta(i), float(v)) for i, v in enumerate(x)], "gauge_id string, date date, q double")
    frame = pd.Series(x, pd.date_range(day, periods=len(x)))
    change = frame.rolling(300, center=True).var().diff().abs()
    years = sorted({t.year for t in change[change > change.quantile(0.9)].index})
    breaks = statistics.detected_breaks(df)
    expected = [y for y in years if 2002 < y < 2006][:3]
    assert breaks.first().breaks == expected and expected
    fits = {r.segment: r for r in statistics.broken_trends(df, breaks).collect()}
    assert set(fits) == set(range(len(expected) + 1)) and {r.gauge_id for r in fits.values()} == {"a|b"}
    p = statistics.with_rank_p(spark.createDataFrame([(0.5, 20), (1.0, 9), (None, 4)], "rho double, n long")).collect()
    t = 0.5 * math.sqrt(18 / 0.75)
    grid = np.linspace(t, 400, 2_000_001)
    density = math.gamma(9.5) / (math.sqrt(18 * math.pi) * math.gamma(9)) * (1 + grid**2 / 18) ** -9.5
    assert p[0].p_value == pytest.approx(2 * np.trapezoid(density, grid), abs=1e-6) and p[1].p_value == 0.0 and p[2].p_value is None


def test_silhouettes_are_means_of_all_distances(spark):
    draw = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(1e4 + draw.normal(0, 1e-4, (40, 3)))]
    rows += [(100, "a", [1.0, None, 2.0]), (101, "b", None), (102, None, [1.0, 2.0, 3.0]), (103, "c", [1.0]), (104, "b", [math.inf, 0.0, 0.0])]
    rows += [(0, "b", rows[1][2]), (None, "a", [1.0, 2.0, 3.0]), (7, "a", rows[0][2]), (8, "a", rows[0][2])]

    def distance(x, y):
        if x is None or y is None:
            return None
        return math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y) if a is not None and b is not None))

    def mean(own, label):
        found = [distance(x, y) for k, l, x in rows if (k, l) == own for k2, l2, y in rows if k2 is not None and k2 != k and l2 == label]
        found = [d for d in found if d is not None]
        return sum(found) / len(found) if found else None

    want = {}
    for own in {(k, label) for k, label, _ in rows if k is not None}:
        a = mean(own, own[1]) if own[1] else None
        b = [d for d in (mean(own, o) for o in "abc" if own[1] and o != own[1]) if d is not None]
        want[own] = 0.0 if a is None or not b or not max(a, min(b)) else (min(b) - a) / max(a, min(b))
    points = spark.createDataFrame(rows, "vec_id long, label string, x array<double>")
    for block in (20_000, 11):
        got = {(r.vec_id, r.label): r.silhouette for r in clusters.silhouettes(points, "vec_id", block=block).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-7) or (math.isnan(got[k]) and math.isnan(want[k])) for k in want), (got, want)
    assert clusters.silhouettes(points.limit(0), "vec_id").collect() == [] and clusters.silhouettes(points.limit(1), "vec_id").collect() == []


def test_silhouettes_of_many_points_in_time(spark):
    """Ten thousand points of 64 components: minutes, if distances were expressions of rows."""
    x = np.random.default_rng(6).normal(size=(10_000, 64)) + np.arange(10_000)[:, None] % 2
    points = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, x array<double>")
    began = time.time()
    got = {r.vec_id: r.silhouette for r in clusters.silhouettes(points, "vec_id").collect()}
    assert len(got) == 10_000 and time.time() - began < 90
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    a, b = d[2::2].mean(), d[1::2].mean()
    assert got[0] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_kmeans_scan_in_time_and_equal_to_single_scores(spark):
    """Eight thousand points of 64 components, three scans: minutes, if distances were expressions of rows."""
    x = np.random.default_rng(8).normal(size=(8_000, 64)) + 3 * (np.arange(8_000)[:, None] % 3)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    began = time.time()
    scan = {r.k: (r.mean, r.least) for r in clusters.kmeans_scan(points, range(2, 5), "vec_id").collect()}
    assert time.time() - began < 90 and sorted(scan) == [2, 3, 4] and max(scan, key=scan.get) == 3
    for k, found in scan.items():
        one = clusters.silhouettes(clusters.kmeans(points, k, "vec_id"), "vec_id").agg(F.avg("silhouette"), F.min("silhouette")).first()
        assert tuple(one) == pytest.approx(found, abs=1e-9)


def test_ward_of_any_number_of_points(spark):
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.normal(c, 0.3, (n, 4)) for c, n in ((0, 3000), (5, 2500), (9, 700))])
    x[100:400] = x[100]  # copies
    rows = [(f"{i:05}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("part", [1.0, None, 2.0, 3.0]), ("nan", [math.nan, 0.0, 0.0, 0.0])]
    got = {r.gauge_id: r.cluster for r in clusters.ward(spark.createDataFrame(rows, "gauge_id string, x array<double>"), 3).collect()}
    assert len(got) == len(rows) and [got.pop(k) for k in ("null", "part", "nan")] == [None] * 3
    labels = [got[f"{i:05}"] for i in range(len(x))]
    assert [set(labels[a:b]) for a, b in ((0, 3000), (3000, 5500), (5500, 6200))] == [{1}, {2}, {3}]


@pytest.mark.parametrize("dear", [20, 0])
def test_ward_merges_the_cheapest_pair_first(monkeypatch, dear):
    """Against merging the cheapest of all pairs again and again, by rounds and by chains."""
    monkeypatch.setattr(kernels._Ward.rounds, "__defaults__", (dear,))
    for seed, (n, width, k) in enumerate(((1, 2, 3), (2, 2, 1), (90, 1, 4), (150, 3, 7), (120, 20, 12))):
        x = np.random.default_rng(seed).normal(size=(n, width)) ** 3 * 10.0 ** (3 * seed) + 10.0**seed
        parts = [[i] for i in range(n)]
        while len(parts) > k:
            pairs = [(i, j) for j in range(len(parts)) for i in range(j)]
            m, s = np.array([x[p].mean(axis=0) for p in parts]), np.array([len(p) for p in parts])
            i, j = np.array(pairs).T
            i, j = pairs[int(np.argmin(((m[i] - m[j]) ** 2).sum(axis=1) * s[i] * s[j] / (s[i] + s[j])))]
            parts[i] += parts.pop(j)
        want = np.empty(n, int)
        for number, part in enumerate(sorted(parts, key=min)):
            want[part] = number + 1
        assert (kernels.ward_labels(x, k) == want).all()
    copies = np.repeat(np.arange(4.0), 25)[:, None]
    assert [len(set(kernels.ward_labels(copies, k))) for k in (1, 3, 4, 10, 200)] == [1, 3, 4, 10, 100]
