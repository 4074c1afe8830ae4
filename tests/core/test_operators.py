"""Operators without SQL: models over frames, files, streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import clusters, features, models, skill, spatial
from freshet.sources import files
from freshet.streaming import ingest


def test_perfect_and_invalid_simulations(spark):
    rows = [("perfect", float(i), float(i)) for i in range(1, 50)] + [("huge", float(i), 1e7) for i in range(1, 50)] + [("flat", 2.0, 3.0)] * 9
    found = {r.gauge_id: r for r in skill.evaluate(spark.createDataFrame(rows, "gauge_id string, obs double, sim double"), ["gauge_id"]).collect()}
    assert found["perfect"].NSE == pytest.approx(1) and found["perfect"].KGE == pytest.approx(1)
    assert found["huge"].KGE == skill.INVALID
    assert found["flat"].NSE is None and found["flat"].KGE is None and found["flat"].PBIAS == pytest.approx(50)


def test_calibration_finds_the_parameters_flow(spark):
    draw = np.random.default_rng(0)
    n = 700
    start = dt.date(2015, 1, 1)
    temp = 10 * np.sin(np.arange(n) / 58) + 15  # never snow
    rain = draw.gamma(0.5, 6, n)
    pet = np.maximum(0, temp) / 6
    from freshet.functions import kernels

    q = kernels.gr4j(rain, pet, np.array([[300.0, 0.0, 60.0, 1.8]]))[:, 0]
    rows = [("g", start + dt.timedelta(days=i), float(rain[i]), float(pet[i]), float(temp[i]), float(q[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "gauge_id string, date date, prcp double, pet double, t_mean double, q double")
    trials = models.calibrate(df, sets=40, rounds=15, warmup_days=100)
    best = models.best_trials(trials).first()
    assert trials.count() == 600 and best.KGE > 0.7
    again = models.best_trials(models.calibrate(df, sets=40, rounds=15, warmup_days=100)).first()
    assert again.params == best.params


def test_weights_of_a_catchment_add_up_to_one(spark):
    ring = [{"lon": 0.1, "lat": 0.2}, {"lon": 1.4, "lat": 0.3}, {"lon": 0.9, "lat": 1.5}]
    df = spark.createDataFrame([("g", ring)], "gauge_id string, ring array<struct<lon:double,lat:double>>")
    assert spatial.cell_weights(df, 0.25).agg(F.sum("w")).first()[0] == pytest.approx(1)


def test_merged_regions_reach_the_target(spark):
    rows = [(q, r, "a" if q < 3 else "b" if q < 6 else f"c{r}") for q in range(7) for r in range(5)]
    out = spatial.merged_regions(spark.createDataFrame(rows, "q long, r long, label string"), 2, 3).collect()
    assert {x.merged for x in out} == {"C1", "C2"} and len(out) == 35


def test_series_files(spark, tmp_path):
    (tmp_path / "00123.csv").write_text("date,q_mm_day\n2020-01-01,1.5\n2020-01-02,-9999\n2020-01-03,\n")
    (tmp_path / "77.csv").write_text("date,q_mm_day\n2020-01-01,1.5\n")
    (tmp_path / "88.csv").write_text("date,q_mm_day\n2020-01-01,\n")
    rows = files.read_series(spark, str(tmp_path))
    assert rows.where("gauge_id = '00123' and q_mm_day is null").count() == 2
    assert sorted(map(tuple, files.classified(rows).collect())) == [("00123", "partial"), ("77", "full")]


def test_metric_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "001_e5l_metrics.json").write_text("﻿" + json.dumps({"NSE": 0.5, "KGE": 0.25}), encoding="utf-8")
    (tmp_path / "a" / "002_gpcp_metrics.json").write_text("not json")
    got = files.read_metrics(spark, str(tmp_path), ["NSE", "KGE"]).collect()
    assert [tuple(r) for r in got] == [("001", "e5l", 0.5, 0.25)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "e5l", 1.0)], "gauge_id string, dataset string, q double")
    for form in files.FORMATS:
        files.write(rows, str(tmp_path / form), form, ("dataset",))
    with pytest.raises(ValueError):
        files.write(rows, str(tmp_path / "x"), "xls")
    assert json.loads(files.class_summary(rows, "dataset"))["classes"][0] == {"name": "e5l", "parts": ["e5l"], "gauges": 1}


def test_strict_scaling_and_lists(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "gauge_id string, v double")
    assert features.min_max(rows, ["v"]).agg(F.sum("v")).first()[0] == 0
    with pytest.raises(Exception, match="constant"):
        features.min_max(rows, ["v"], strict=True).collect()


def test_names(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.8, 0.1), (2, 0.1, 0.2, 0.3)], "c int, a double, b double, d double")
    assert [r.description for r in clusters.named(rows, ["a", "b", "d"]).orderBy("c").collect()] == ["a=0.90, b=0.80", "average"]


READINGS = [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 13:00:00", 3.0), ("b", "2024-01-02 00:00:00", 5.0), ("a", "2024-01-09 00:00:00", 9.0)]


def readings(spark, rows):
    return spark.createDataFrame(rows, "gauge_id string, ts string, level double").withColumn("ts", F.to_timestamp("ts"))


def test_stream_equals_batch_and_first_value_wins(spark, tmp_path):
    source = str(tmp_path / "in")
    readings(spark, READINGS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("gauge_id string, ts timestamp, level double").parquet(source)
    path = str(tmp_path / "history")
    ingest.start_history(stream, path, str(tmp_path / "cp")).awaitTermination()
    got = {(r.gauge_id, str(r.date)): r.level for r in ingest.read_history(spark, path).collect()}
    batch = {(r.gauge_id, str(r.date)): r.level for r in ingest.daily_means(readings(spark, READINGS)).collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and ("a", "2024-01-01") in got
    late = ingest.daily_means(readings(spark, [("a", "2024-01-01 05:00:00", 100.0), ("c", "2024-01-03 00:00:00", 1.0)]))
    ingest.merge_history(spark, late, path)
    now = {(r.gauge_id, str(r.date)): r.level for r in ingest.read_history(spark, path).collect()}
    assert now["a", "2024-01-01"] == got["a", "2024-01-01"] and now["c", "2024-01-03"] == 1.0


def test_events_span_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, rows in enumerate(([("a", "2024-01-01 00:00:00", 5.0), ("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 02:00:00", 6.0)], [("a", "2024-01-01 03:00:00", 8.0), ("a", "2024-01-01 04:00:00", 0.0)])):
        readings(spark, rows).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("gauge_id string, ts timestamp, level double").option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.open_events(stream, 4.0).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.peak, r.n) for r in spark.table("found").collect()) == [(5.0, 1), (8.0, 2)]


def test_plans_push_down_and_prune(spark):
    from freshet.plans.panels import flow

    plan = flow(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and plan.count("ReadSchema") == 2
    assert "l_extendedprice" not in plan


def test_blocks_of_signatures_share_one_scan(spark):
    from freshet.operators import signatures
    from freshet.plans.panels import flow

    df = signatures.extreme_metrics(flow(spark, "/root/testdata/sf0.001"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # eight aggregates and windows read the panel of two tables; exchanges are reused, so few scans remain
    assert plan.count("Scan parquet") <= 4 and "ReusedExchange" in plan
