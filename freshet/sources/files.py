"""Readers and writers of series, attributes, metrics and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.expr import clean

SERIES = T.StructType([T.StructField("date", T.DateType()), T.StructField("q_mm_day", T.DoubleType())])
FORMATS = ("parquet", "csv", "json", "orc")


def read_series(spark: SparkSession, path: str, schema: T.StructType = SERIES) -> DataFrame:
    """Files named <gauge_id>.csv with a header: rows with gauge_id (text) and the schema's columns,
    sentinels and NaN as null."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    numbers = {f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)}
    return rows.select(name.alias("gauge_id"), *(clean(f).alias(f) if f in numbers else F.col(f) for f in schema.names))


def classified(rows: DataFrame, value: str = "q_mm_day") -> DataFrame:
    """(gauge_id, status): full without nulls, partial with some; gauges without any value are left out."""
    shares = rows.groupBy("gauge_id").agg((F.count(value) / F.count("*")).alias("_s")).where("_s > 0")
    return shares.select("gauge_id", F.when(F.col("_s") == 1, "full").otherwise("partial").alias("status"))


def read_attributes(spark: SparkSession, path: str, gauges: DataFrame | None = None) -> DataFrame:
    """A table of attributes by gauge_id, which stays text; only the given gauges, if any. A given gauge
    without attributes is an error, which names some."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    rows = rows.select("gauge_id", *(F.col(c).try_cast("double").alias(c) for c in rows.columns if c != "gauge_id"))
    if gauges is None:
        return rows
    missing = [r[0] for r in gauges.select("gauge_id").distinct().join(rows, "gauge_id", "left_anti").limit(5).collect()]
    if missing:
        raise KeyError(f"no attributes of gauges {', '.join(map(str, missing))}")
    return rows.join(gauges.select("gauge_id"), "gauge_id", "left_semi")


def read_metrics(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files <gauge>_<dataset>_metrics.json, one object each: (gauge_id, dataset, names). Files that are
    no JSON objects are skipped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_metrics.json").text(path, wholetext=True)
    base = F.regexp_extract(F.input_file_name(), r"([^/]+)_metrics\.json", 1)
    schema = ", ".join(f"{n} double" for n in names)
    rows = files.select(
        F.regexp_extract(base, "^([^_]+)", 1).alias("gauge_id"), F.regexp_extract(base, "^[^_]+_(.*)$", 1).alias("dataset"),
        F.from_json(F.regexp_replace("value", "^﻿", ""), schema, {"mode": "PERMISSIVE"}).alias("_m"),
        F.try_parse_json(F.regexp_replace("value", "^﻿", "")).isNotNull().alias("_ok"),
    )
    return rows.where("_ok").select("gauge_id", "dataset", "_m.*")


def write(rows: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Rows as a table in one of FORMATS, partitioned by columns."""
    if form not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = rows.write.mode("overwrite").format(form).partitionBy(*by)
    (writer.option("header", True) if form == "csv" else writer).save(path)


def unfinished(tasks: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose keys have no result yet."""
    return tasks.join(results, keys, "left_anti")


def class_summary(rows: DataFrame, label: str, most: int = 1000) -> str:
    """JSON text of the classes and their sizes, largest first; classes must be few."""
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError("too many classes for a summary")
    return json.dumps({"classes": [{"name": r[0], "parts": str(r[0]).split("-"), "gauges": r[1]} for r in counts]}, indent=2, ensure_ascii=False)
