"""Sub-daily readings as a stream: daily means, a history where the first value wins, open events.

Readings are (gauge_id, ts timestamp, level double).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet.operators.features import upsert


def daily_means(readings: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(gauge_id, date, level, n) over days; a stream emits a day once the watermark has passed it."""
    rows = readings.withWatermark("ts", lateness) if readings.isStreaming else readings
    days = rows.groupBy("gauge_id", F.window("ts", "1 day").alias("_w")).agg(F.avg("level").alias("level"), F.count("level").alias("n"))
    return days.select("gauge_id", F.to_date("_w.start").alias("date"), "level", "n")


def merge_history(spark: SparkSession, batch: DataFrame, path: str, keys: tuple[str, ...] = ("gauge_id", "date"), kept: int = 2) -> None:
    """Merge a batch into the Parquet history at path: a value that is there stays. Every merge writes a
    version of its own and never touches another; the highest one that is complete is the history, so
    a merge that breaks off at any point loses nothing. Only the newest `kept` versions stay, the older
    ones for readers that have begun."""
    number = current(spark, path)
    old = spark.read.parquet(f"{path}/v{number}") if number else None
    merged = batch if old is None else upsert(old, batch.select(*old.columns), list(keys), "old")
    merged.write.mode("overwrite").parquet(f"{path}/v{number + 1}")
    for done in versions(spark, path):
        if done <= number + 1 - kept:
            where, system = _path(spark, f"{path}/v{done}")
            system.delete(where, True)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the history at path: those with the mark that a write leaves last."""
    where, system = _path(spark, path)
    if not system.exists(where):
        return []
    names = [x.getPath().getName() for x in system.listStatus(where)]
    found = [int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit()]
    return sorted(n for n in found if system.exists(_path(spark, f"{path}/v{n}/_SUCCESS")[0]))


def current(spark: SparkSession, path: str) -> int:
    """Version of the history at path; 0: none yet."""
    return max(versions(spark, path), default=0)


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    number = current(spark, path)
    return spark.read.parquet(f"{path}/v{number}") if number else None


def start_history(readings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep the history at path up to date with a stream of readings."""
    spark = readings.sparkSession
    days = daily_means(readings)
    return (
        days.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, _: merge_history(spark, batch, path)).start()
    )


EVENT = "gauge_id string, start timestamp, end timestamp, peak double, n long"


def open_events(readings: DataFrame, threshold: float, lateness: str = "2 days") -> DataFrame:
    """Events of levels above the threshold as a stream: one row when an event ends. An event may span
    micro-batches; its start, last time, peak and count are the state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(frames).sort_values("ts")
        out = []
        for ts, level in zip(rows["ts"], rows["level"]):
            micros = ts.value // 1000
            if level > threshold:
                held = (micros, micros, level, 1) if held is None else (held[0], micros, max(held[2], level), held[3] + 1)
            elif held is not None:
                out.append((key[0], pd.Timestamp(held[0], unit="us"), pd.Timestamp(micros, unit="us"), held[2], held[3]))
                held = None
        if held is not None:
            state.update(held)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["gauge_id", "start", "end", "peak", "n"])

    rows = readings.where("level is not null").withWatermark("ts", lateness)
    return rows.groupBy("gauge_id").applyInPandasWithState(run, EVENT, "start long, last long, peak double, n long", "append", GroupStateTimeout.NoTimeout)
