"""Tables around the analysis: summaries, bins, rankings, filters by missing values, units, extents.

Missing values are null throughout. Nothing is collected; rankings are by total orders, so ties never
depend on how rows are dealt.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.expr import col, div, pearson, quantile

KEY, TIME = "gauge_id", "date"
#: Factors and offsets of unit conversions, and score bins with their names: fixed values.
UNITS = {"kelvin": (1.0, -273.15), "hundredfold": (100.0, 0.0), "thousandfold": (1000.0, 0.0), "kilogram_seconds": (1e5, 0.0), "tenth": (0.1, 0.0)}
SCORE_BINS = [
    (None, 0.0, "Negative (worse than mean)"), (0.0, 0.5, "Poor"), (0.5, 0.7, "Acceptable"), (0.7, 0.8, "Good"), (0.8, None, "Excellent"),
]


def mean_temperature(low: Column | str, high: Column | str) -> Column:
    """Middle of the day's lowest and highest temperature."""
    return (col(low) + col(high)) / 2


def converted(rows: DataFrame, units: dict[str, str]) -> DataFrame:
    """Columns in other units: {column: name of a conversion in UNITS}."""
    for name, unit in units.items():
        factor, offset = UNITS[unit]
        rows = rows.withColumn(name, F.col(name) * factor + offset)
    return rows


def plausible(series: DataFrame, value: str = "q", most: float = 50.0) -> DataFrame:
    """Rows of gauges whose highest value stays below `most`."""
    fine = series.groupBy(KEY).agg(F.max(value).alias("_top")).where(F.col("_top") < most).select(KEY)
    return series.join(fine, KEY, "left_semi")


def label_order(label: Column | str) -> list[Column]:
    """Sort keys of class labels: their letters in front, then their first number, then the label."""
    return [F.regexp_extract(col(label), "^[A-Za-z]*", 0), F.regexp_extract(col(label), r"\d+", 0).try_cast("int"), col(label)]


def merged(frames: list[DataFrame], key: str = KEY) -> DataFrame:
    """Inner join of several tables on a key."""
    return reduce(lambda a, b: a.join(b, key), frames)


def overridden(base: DataFrame, other: DataFrame, column: str, start: str, end: str, keys: tuple[str, ...] = (KEY, TIME)) -> DataFrame:
    """base with a column's values of other within a period, where other has the row."""
    theirs = other.select(*keys, F.col(column).alias("_theirs"), F.lit(True).alias("_there"))
    inside = F.col(TIME).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("_there").isNotNull()
    value = F.when(inside, F.col("_theirs")).otherwise(F.col(column))
    return base.join(theirs, list(keys), "left").select(*(value.alias(c) if c == column else F.col(c) for c in base.columns))


def described(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """(by, metric, n, median, mean) of every metric."""
    return rows.unpivot(by, metrics, "metric", "_v").groupBy(*by, "metric").agg(F.count("_v").alias("n"), F.median("_v").alias("median"), F.avg("_v").alias("mean"))


def histogram(rows: DataFrame, value: str, edges: list[float], lowest: bool = False) -> DataFrame:
    """(bin, low, high, n, share) of the bins (a, b] between the edges, empty ones too; lowest: the first
    bin holds its lower edge; values outside count for the share alone."""
    found = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        above = F.col(value) >= a if lowest and not i else F.col(value) > a
        found.append(F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.count_if(above & (F.col(value) <= b)).alias("n")))
    bins = rows.agg(F.array(*found).alias("_b"), F.count(value).alias("_all")).select("_all", F.inline("_b"))
    return bins.select("bin", "low", "high", "n", div("n", "_all").alias("share"))


def score_bins(rows: DataFrame, score: str = "NSE", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, n, percent) of scores in SCORE_BINS, right-closed; percent of all rows, null ones too."""
    label = F.lit(None).cast("string")
    for a, b, name in SCORE_BINS:
        inside = F.col(score).isNotNull()
        inside = inside & (F.col(score) > a) if a is not None else inside
        inside = inside & (F.col(score) <= b) if b is not None else inside
        label = F.when(inside, F.lit(name)).otherwise(label)
    counts = rows.groupBy(*by, label.alias("label")).agg(F.count("*").alias("n"))
    # at most as many labels as bins, and one for null, in each group
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("percent", share).where("label is not null")


def coverage(cells: DataFrame, count: str = "n") -> DataFrame:
    """One row: cells, their sum, mean, median, tenth and ninetieth percentile, least and most."""
    return cells.agg(
        F.count("*").cast("double").alias("total_hexes"), F.sum(count).cast("double").alias("total_watersheds"), F.avg(count).alias("mean_count"),
        F.median(count).alias("median_count"), quantile(count, 0.1).alias("p10_count"), quantile(count, 0.9).alias("p90_count"),
        F.min(count).cast("double").alias("min_count"), F.max(count).cast("double").alias("max_count"),
    )


def area_trend(rows: DataFrame, area: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, slope, intercept, r, r_log): line of a score over the logarithm of the area, and the score's
    correlation with the area and its logarithm."""
    x = F.when(F.col(area) > 0, F.log10(F.col(area)))
    return rows.groupBy(*by).agg(
        F.regr_slope(F.col(score), x).alias("slope"), F.regr_intercept(F.col(score), x).alias("intercept"), pearson(area, score).alias("r"), pearson(x, score).alias("r_log")
    )


def extremes(rows: DataFrame, value: str, n: int, order: str, largest: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The n rows with the largest (or smallest) values, of all or of each group; ties by `order`; null
    values never come. Of all: each task keeps n rows, and only those meet."""
    rows = rows.where(F.col(value).isNotNull())
    sort = [F.desc(value) if largest else F.asc(value), F.asc(order)]
    if not by:
        return rows.orderBy(*sort).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*sort))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def worst(rows: DataFrame, deltas: list[str], n: int = 100, key: str = KEY) -> DataFrame:
    """(key, mean_delta): the n rows with the least mean of the deltas, over those present."""
    present = F.filter(F.array(*deltas), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(present), F.lit(0))
    return extremes(rows.select(key, mean.alias("mean_delta")), "mean_delta", n, key, largest=False)


def reindexed(rows: DataFrame, keys: DataFrame, key: str = KEY, fill: dict | None = None) -> DataFrame:
    """A row for every key of keys: those of rows, or one filled (null where fill says nothing)."""
    out = keys.select(key).distinct().join(rows, key, "left")
    return out.na.fill(fill) if fill else out


def snapped_extent(bounds: list[Column], step: float) -> list[Column]:
    """(min_lon, max_lon, min_lat, max_lat) moved out to the decimals of twice the step; an extent of no
    more than one such cell is widened by a step on both sides."""
    cell = step * 2
    digits = _decimals(cell)

    def out(x, up):
        scale = float(10**digits)
        return (F.ceil(x * scale) if up else F.floor(x * scale)) / scale

    found = []
    for low, high in ((bounds[0], bounds[1]), (bounds[2], bounds[3])):
        a, b = out(low, False), out(high, True)
        narrow = F.round(F.abs(a - b), 3) <= cell
        pair = (F.when(narrow, out(a - step, False)).otherwise(a), F.when(narrow, out(b + step, True)).otherwise(b))
        found += [F.round(x, _decimals(step)) for x in pair]
    return found


def _decimals(step: float) -> int:
    digits = max(0, -int(math.floor(math.log10(step)))) if step < 1 else 0
    while round(step, digits) != step:
        digits += 1
    return digits


def within(cube: DataFrame, extent: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows of a grid inside (min_lon, max_lon, min_lat, max_lat), borders included: plain comparisons,
    which reach the scan."""
    return cube.where(F.col(lon).between(extent[0], extent[1]) & F.col(lat).between(extent[2], extent[3]))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of (lon, lat) corners, by the parity of the edges to its right."""
    nexts = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crossed(a, b):
        return ((a["lat"] > y) != (b["lat"] > y)) & (x < (b["lon"] - a["lon"]) * div(y - a["lat"], b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(F.zip_with(ring, nexts, crossed), lambda hit: hit)) % 2 == 1


def points_in_rings(points: DataFrame, rings: DataFrame, ring_key: str, tile: float = 1.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with the key of every ring (ring_key, ring) that they lie in. Points and rings meet in tiles
    of `tile` degrees, an equi-join: a ring goes to the tiles of its bounds, a point to its own."""
    at = lambda x: F.floor(x / tile).cast("long")
    lons, lats = F.transform("ring", lambda c: c["lon"]), F.transform("ring", lambda c: c["lat"])
    tiles = rings.select(
        ring_key, "ring", F.explode(F.sequence(at(F.array_min(lons)), at(F.array_max(lons)))).alias("_tx"),
        F.sequence(at(F.array_min(lats)), at(F.array_max(lats))).alias("_ty"),
    ).withColumn("_ty", F.explode("_ty"))
    near = points.withColumn("_tx", at(F.col(lon))).withColumn("_ty", at(F.col(lat))).join(tiles, ["_tx", "_ty"])
    return near.where(inside(F.col(lon), F.col(lat), F.col("ring"))).drop("_tx", "_ty", "ring")


def forecast_appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """A gauge's long list of forecasts: the rows of old, and those of new with forecast_horizon, their
    place in the new forecast from 0."""
    horizon = F.row_number().over(Window.partitionBy(KEY).orderBy(TIME)) - 1
    return old.unionByName(new.withColumn("forecast_horizon", horizon.cast("int")), allowMissingColumns=True)


def stitched(parts: list[DataFrame]) -> DataFrame:
    """Gauges of several lists of stations (gauge_id, name, height): the greatest height, and the name of
    the first list that has one."""
    rows = reduce(DataFrame.unionByName, (p.select(KEY, "name", "height", F.lit(i).alias("_i")) for i, p in enumerate(parts)))
    return rows.groupBy(KEY).agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("_i", "name"))).alias("name"), F.max("height").alias("height"))


def legacy_years(series: DataFrame, time: str = TIME) -> DataFrame:
    """series with the hydrological year of the old convention, 1 October to the next 1 October inclusive:
    a 1 October is in two."""
    year = F.year(time) + (F.month(time) >= 10).cast("int")
    first = (F.month(time) == 10) & (F.dayofmonth(time) == 1)
    return series.withColumn("year", F.explode(F.when(first, F.array(year - 1, year)).otherwise(F.array(year))))


def within_budget(series: DataFrame, value: str, most: float, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Rows of groups of whose rows no more than the share `most` miss the value."""
    fine = series.groupBy(*by).agg((F.count_if(F.col(value).isNull()) / F.count("*")).alias("_s")).where(F.col("_s") <= most)
    return series.join(fine.select(*by), list(by), "left_semi")


def missing_classes(series: DataFrame, value: str = "q", partial: float = 0.25) -> DataFrame:
    """(gauge_id, missing, status): full, partial (up to a quarter missing), sparse, empty."""
    share = F.col("missing")
    status = F.when(share == 0, "full").when(share <= partial, "partial").when(share < 1, "sparse").otherwise("empty")
    return series.groupBy(KEY).agg((F.count_if(F.col(value).isNull()) / F.count("*")).alias("missing")).withColumn("status", status)


def monthly_deltas(rows: DataFrame, obs: str, sim: str, district: str) -> DataFrame:
    """(district, month, delta): the gauges' median difference of a month, and the median over a district's gauges."""
    own = rows.groupBy(district, KEY, F.month(TIME).alias("month")).agg(F.median(F.col(sim) - F.col(obs)).alias("_d"))
    return own.groupBy(district, "month").agg(F.median("_d").alias("delta"), F.count("_d").alias("gauges"))


def area_check(rows: DataFrame, known: str, computed: str, most: float = 15.0) -> DataFrame:
    """rows with area_difference in percent of the known area, and whether it is within `most`."""
    difference = div(F.col(known) - F.col(computed), known) * 100
    return rows.withColumn("area_difference", difference).withColumn("area_matches", F.abs(difference) < most)


def joined_medians(tables: dict[str, DataFrame], metric: str) -> DataFrame:
    """One row: each table's median of a metric over the gauges that all of them have it for."""
    rows = merged([t.select(KEY, F.col(metric).alias(name)).na.drop() for name, t in tables.items()])
    return rows.agg(F.count("*").alias("gauges"), *(F.median(name).alias(name) for name in tables))


def detection_medians(rows: DataFrame, only: DataFrame | None = None, without_zeros: bool = False) -> DataFrame:
    """One row: median recall, precision and rmse, of the gauges of `only`; without_zeros leaves out those
    without any precision or recall."""
    rows = rows.join(only.select(KEY), KEY, "left_semi") if only is not None else rows
    if without_zeros:
        rows = rows.where((F.col("precision") != 0) & (F.col("recall") != 0))
    return rows.agg(*(F.median(c).alias(f"median_{c}") for c in ("recall", "precision", "rmse")))


def model_ranking(rows: DataFrame, truth: str, models: list[str], by: tuple[str, ...] = (KEY,), most_missing: float = 0.1) -> DataFrame:
    """(by, model, r, error, place): models by the error of their mean in percent, then by correlation.
    Those with more than most_missing of their rows missing are left out; feed interpolated rows."""
    long = rows.unpivot([*by, truth], models, "model", "_m")
    both = F.col("_m").isNotNull()
    found = long.groupBy(*by, "model").agg(
        (F.count_if(~both) / F.count("*")).alias("_s"), pearson(truth, "_m").alias("r"),
        F.abs(div(F.avg(F.when(both, F.col(truth) - F.col("_m"))), F.avg(truth)) * 100).alias("error"),
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy("error", "r", "model"))
    return found.where(F.col("_s") <= most_missing).drop("_s").withColumn("place", place)


def river_rank(accumulation: Column | str) -> Column:
    """Decade of a flow accumulation."""
    return F.when(col(accumulation) > 0, F.floor(F.log10(col(accumulation)))).cast("int")
