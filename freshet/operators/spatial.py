"""Catchments, hexagons and grids as plain columns: areas, buffers, hexagon votes, cell weights.

A polygon is array<struct<lon double, lat double>>, its ring open or closed. Hexagons are pointy-top on
projected coordinates; a point's hexagon is a closed formula, so a spatial join is an equi-join.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.expr import col, div, quantile
from freshet.functions.kernels import clipped_area

KEY, TIME = "gauge_id", "date"
RADIUS = 6_378_137.0
#: Buffer in degrees around a gauge by catchment area below, km2 (fixed values).
BUFFERS = [(2000, 0.05), (10000, 0.10), (50000, 0.20)]
WIDEST = 0.30


def polygon_area(ring: Column | str, radius: float = RADIUS) -> Column:
    """Area in km2 on the sphere: half the squared radius times |sum of (lon2 - lon1) * (2 + sin lat1 + sin lat2)|."""
    points = col(ring)
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    parts = F.zip_with(points, following, lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) * (radius * radius / 2 / 1e6)


def largest_part(rings: Column | str) -> Column:
    """Ring with the largest area of array<ring>."""
    sized = F.transform(col(rings), lambda r: F.struct(polygon_area(r).alias("a"), r.alias("r")))
    return F.array_max(sized)["r"]


def within_longitude(ring: Column | str, longest: float) -> Column:
    return F.array_max(F.transform(col(ring), lambda p: p["lon"])) <= longest


def buffer_degrees(area: Column | str) -> Column:
    out = F.when(col(area) < BUFFERS[0][0], BUFFERS[0][1])
    for bound, degrees in BUFFERS[1:]:
        out = out.when(col(area) < bound, degrees)
    return out.when(col(area).isNotNull(), WIDEST)


def utm_zone(lon: Column | str) -> Column:
    return (F.floor((col(lon) + 180) / 6) + 1).cast("int")


def equal_area(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Cylindrical equal-area metres (on the sphere, true at 30 degrees)."""
    k = math.cos(math.radians(30))
    return F.radians(col(lon)) * RADIUS * k, F.sin(F.radians(col(lat))) * (RADIUS / k)


def hexagon(x: Column | str, y: Column | str, radius: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the pointy-top hexagon of that circumradius around the point."""
    q = (col(x) * (math.sqrt(3) / 3) - col(y) / 3) / radius
    r = col(y) * (2 / 3) / radius
    s = -q - r
    near = lambda v: F.floor(v + 0.5)
    rq, rr, rs = near(q), near(r), near(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_out = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r_out = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q_out.cast("long"), r_out.cast("long")


def neighbours(hexes: DataFrame) -> DataFrame:
    """(q, r, nq, nr): adjacent pairs of the hexagons there are."""
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))))
    pairs = hexes.select("q", "r", F.explode(around).alias("_o")).select("q", "r", (F.col("q") + F.col("_o.a")).alias("nq"), (F.col("r") + F.col("_o.b")).alias("nr"))
    return pairs.join(hexes.select(F.col("q").alias("nq"), F.col("r").alias("nr")), ["nq", "nr"], "left_semi").select("q", "r", "nq", "nr")


def hex_values(rows: DataFrame, cell: list[str], value: str, negative_share: float = 0.5) -> DataFrame:
    """Median, mean, extremes and count per cell, and score: the median, or the minimum where more than
    negative_share of the values are below zero."""
    share = F.avg((F.col(value) < 0).cast("double"))
    return rows.groupBy(*cell).agg(
        F.count(value).alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.when(share > negative_share, F.min(value)).otherwise(F.median(value)).alias("score"),
    )


def dominant(rows: DataFrame, cell: list[str], label: str, least: int = 1, ambiguous_below: float | None = None) -> DataFrame:
    """Most frequent label per cell (the smallest of equals), its share, the number of labels and their
    Shannon diversity; cells of fewer than `least` rows are left out, and a share below the limit is
    labelled ambiguous."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*cell, F.col(label).cast("string").alias("_l")).agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(*cell))
    counts = counts.withColumn("_p", F.col("_c") / total)
    out = counts.groupBy(*cell).agg(
        F.sum("_c").alias("n"), F.count("*").alias("n_types"), F.min_by("_l", F.struct(-F.col("_c"), F.col("_l"))).alias("dominant"),
        F.max("_p").alias("share"), (F.lit(0.0) - F.sum(F.col("_p") * F.ln("_p"))).alias("diversity"),
    ).where(F.col("n") >= least)
    if ambiguous_below is not None:
        out = out.withColumn("dominant", F.when(F.col("share") < ambiguous_below, "ambiguous").otherwise(F.col("dominant")))
    return out


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Long crosstab with margins: (a, b, n, row_share); "All" stands for a margin."""
    cube = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    cube = cube.select(F.coalesce("a", F.lit("All")).alias("a"), F.coalesce("b", F.lit("All")).alias("b"), "n")
    whole = F.max("n").over(Window.partitionBy("a"))
    return cube.select("a", "b", "n", (F.col("n") / whole * 100).alias("row_share"))


def suggested_radius(areas: DataFrame, area: str, target: float = 3.0, share: float = 0.5, low: float = 10.0, high: float = 200.0) -> DataFrame:
    """Circumradius of a hexagon that holds about `target` catchments of the quantile's area, within limits."""
    wanted = F.sqrt(quantile(area, share) * target / 2.598)
    return areas.agg(F.greatest(F.lit(low), F.least(F.lit(high), wanted)).alias("radius"))


def cell_candidates(catchments: DataFrame, step: float) -> DataFrame:
    """(gauge_id, ring, ix, iy): the cells of a regular grid that a ring's bounding box meets. Cell
    (ix, iy) is centred on (ix * step, iy * step)."""
    edge = lambda f, axis, up: F.floor(f(F.transform("ring", lambda p: p[axis])) / step + 0.5).cast("long")
    xs = F.sequence(edge(F.array_min, "lon", 0), edge(F.array_max, "lon", 1))
    ys = F.sequence(edge(F.array_min, "lat", 0), edge(F.array_max, "lat", 1))
    return catchments.select(KEY, "ring", F.explode(xs).alias("ix"), ys.alias("_ys")).select(KEY, "ring", "ix", F.explode("_ys").alias("iy"))


def cell_weights(catchments: DataFrame, step: float) -> DataFrame:
    """(gauge_id, ix, iy, w): share of each catchment that lies in each cell; the shares of a catchment
    add up to 1. Areas are planar in the ring's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ring, ix, iy in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                points = np.array([(p["lon"], p["lat"]) for p in ring])
                out.append(clipped_area(points, (ix - 0.5) * step, (iy - 0.5) * step, (ix + 0.5) * step, (iy + 0.5) * step))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.float64())], names=[KEY, "ix", "iy", "a"])

    areas = cell_candidates(catchments, step).mapInArrow(run, f"{KEY} string, ix long, iy long, a double").where("a > 0")
    return areas.select(KEY, "ix", "iy", div(F.col("a"), F.sum("a").over(Window.partitionBy(KEY))).alias("w"))


def is_summed(variable: str) -> bool:
    """Whether a variable of that name is summed over an area rather than averaged."""
    return any(word in variable.lower() for word in ("pr", "tp", "rain", "snow", "evap", "runoff"))


def areal_series(grid: DataFrame, weights: DataFrame, variable: str, summed: bool | None = None, magnitude: float = 100.0, not_negative: bool = False) -> DataFrame:
    """(gauge_id, time, value) of a grid (time, ix, iy, value): sum(w * x) * magnitude for summed
    variables, else sum(w * x) / sum(w) over the cells with a value."""
    summed = is_summed(variable) if summed is None else summed
    rows = grid.join(weights, ["ix", "iy"])
    x, w = F.col("value"), F.when(F.col("value").isNotNull(), F.col("w"))
    value = F.sum(x * w) * magnitude if summed else div(F.sum(x * w), F.sum(w))
    out = rows.groupBy(KEY, "time").agg(value.alias("value"))
    return out.withColumn("value", F.greatest(F.lit(0.0), "value")) if not_negative else out


def weighted_attributes(parts: DataFrame, weight: str, names: dict[str, float]) -> DataFrame:
    """Area-weighted attributes, each divided by its unit's factor; a null counts as 0 and keeps its weight."""
    w = F.col(weight)
    return parts.groupBy(KEY).agg(*(div(F.sum(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * w), F.sum(w) * f).alias(n) for n, f in names.items()))


def snapped(x: Column | str, step: float, up: bool = False) -> Column:
    """Rounded down or up to as many decimals as the step has (not to its multiples)."""
    digits = max(0, -int(math.floor(math.log10(step)))) if step < 1 else 0
    while round(step, digits) != step:
        digits += 1
    scale = 10**digits
    return (F.ceil(col(x) * scale) if up else F.floor(col(x) * scale)) / scale


def merged_regions(hexes: DataFrame, target: int, least: int = 5, rounds: int = 50) -> DataFrame:
    """(q, r, label, merged): labels of fewer than `least` hexagons (or else half of what is above the
    target, the smallest) take their neighbours' most frequent label, round by round, until `target`
    remain; then renamed C1, C2, ... by size. A round changes no more labels than are above the target,
    the smallest first, all their hexagons at once. Labels are few: their counts are what the driver sees."""
    links = neighbours(hexes.select("q", "r"))
    spark = hexes.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-"))
    rows = hexes.select("q", "r", F.col("label").cast("string").alias("label"), F.col("label").cast("string").alias("now"))
    for _ in range(rounds):
        sizes = sorted(((r["count"], r["now"]) for r in rows.groupBy("now").count().collect()))
        if len(sizes) <= target:
            break
        small = [x for n, x in sizes if n < least] or [x for _, x in sizes[: max(1, (len(sizes) - target) // 2)]]
        small = small[: len(sizes) - target]
        around = rows.where(F.col("now").isin(small)).join(links, ["q", "r"]).join(
            rows.select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("now").alias("_n")), ["nq", "nr"]
        ).where("_n <> now")
        votes = around.groupBy("q", "r").agg(F.mode("_n", True).alias("_to"))
        if votes.isEmpty():
            break
        rows = rows.join(votes, ["q", "r"], "left").select("q", "r", "label", F.coalesce("_to", "now").alias("now")).checkpoint()
    rank = rows.groupBy("now").count().withColumn("_k", F.row_number().over(Window.orderBy(F.desc("count"), "now")))
    return rows.join(F.broadcast(rank), "now").select("q", "r", "label", F.concat(F.lit("C"), F.col("_k").cast("string")).alias("merged"))
