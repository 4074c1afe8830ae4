"""Features and reshaping of panels: rolling windows, calendar terms, scaling, classes, joins and upserts."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.expr import by, col, div, quantile

KEY, TIME = "gauge_id", "date"
#: Bounds of catchment size classes, km2, and their names (fixed values). The first bound is open.
SIZES = [
    (100, "a) < 100 $km^2$"), (2000, "b) 100 $km^2$ - 2 000 $km^2$"), (10000, "c) 2 000 $km^2$ - 10 000 $km^2$"),
    (50000, "d) 10 000 $km^2$ - 50 000 $km^2$"), (200000, "e) 50 000 $km^2$ - 200 000 $km^2$"),
]
LARGEST = "f) > 200 000 $km^2$"


def rolling(rows: DataFrame, columns: dict[str, str], widths: tuple[int, ...] = (1, 2, 4, 8, 16, 32), full: bool = False) -> DataFrame:
    """rows with {column}_{sum|mean}_{w}d over the last w rows of the key; columns: name to "sum" or
    "mean". full: null until w rows are there."""
    steps, out = {"sum": F.sum, "mean": F.avg}, []
    w = by(KEY, TIME)
    for name, how in columns.items():
        for n in widths:
            value = steps[how](name).over(w.rowsBetween(-(n - 1), 0))
            value = F.when(F.row_number().over(w) >= n, value) if full else value
            out.append(value.alias(f"{name}_{how}_{n}d"))
    return rows.select("*", *out)


def cyclic_day(date: Column | str, days: float = 366) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year; days: length of the circle."""
    angle = 2 * math.pi * F.dayofyear(col(date)) / F.lit(float(days))
    return F.sin(angle), F.cos(angle)


def pet_oudin(temp: Column | str, day: Column | str, latitude: Column | str) -> Column:
    """Potential evapotranspiration, mm/day: extraterrestrial radiation over 2.45, times (T + 5) / 100,
    not below zero."""
    doy, lat, t = col(day), F.radians(col(latitude)), col(temp)
    distance = 1 + 0.033 * F.cos(2 * math.pi * doy / 365)
    tilt = 0.409 * F.sin(2 * math.pi * doy / 365 - 1.39)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(lat) * F.tan(tilt))))
    radiation = 24 * 60 / math.pi * 0.082 * distance * (sunset * F.sin(lat) * F.sin(tilt) + F.cos(lat) * F.cos(tilt) * F.sin(sunset))
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), radiation / 2.45 * (t + 5) / 100))


def size_class(area: Column | str) -> Column:
    a = col(area)
    out = F.when(a < SIZES[0][0], SIZES[0][1])
    for bound, name in SIZES[1:]:
        out = out.when(a <= bound, name)
    return out.when(a.isNotNull(), LARGEST)


def mm_per_day(flow: Column | str, area_km2: Column | str) -> Column:
    """Depth in mm a day of a flow in m3/s over an area in km2."""
    return div(col(flow) * 86400 * 1000, col(area_km2) * 1e6)


def cleaned_number(text: Column | str) -> Column:
    """A number from a hand-written table: commas as points, dry and frozen marks as 0, question marks
    and other letters dropped."""
    value = F.regexp_replace(F.lower(F.trim(col(text))), "^(прсх|прмз)$", "0")
    return F.regexp_replace(F.regexp_replace(value, ",", "."), "[^-0-9.]", "").try_cast("double")


def min_max(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Columns scaled to 0 to 1 over each group; a constant column becomes 0, or an error if strict."""
    stats = rows.groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    joined = rows.join(stats, list(keys)) if keys else rows.crossJoin(F.broadcast(stats))  # one row of extremes
    out = []
    for c in rows.columns:
        if c not in columns:
            out.append(F.col(c))
            continue
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        safe = F.when(span == 0, F.raise_error(F.lit(f"column {c} is constant")).cast("double") if strict else F.lit(1.0)).otherwise(span)
        out.append(((F.col(c) - F.col(f"_lo_{c}")) / safe).alias(c))
    return joined.select(*out)


def winsorised(rows: DataFrame, columns: dict[str, tuple[float, float]], logged: tuple[str, ...] = ()) -> DataFrame:
    """Columns held between two of their quantiles; those of logged are log(1 + x) first."""
    base = rows.select(*(F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias(c) if c in logged else F.col(c) for c in rows.columns))
    stats = base.agg(*(quantile(c, p).alias(f"_{n}_{c}") for c, ps in columns.items() for n, p in zip(("lo", "hi"), ps)))
    joined = base.crossJoin(F.broadcast(stats))  # one row of quantiles
    held = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_lo_{c}"), F.least(F.col(f"_hi_{c}"), F.col(c))))
    return joined.select(*(held(c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def quantile_classes(rows: DataFrame, value: str, cuts: tuple[float, float] = (0.33, 0.67), name: str = "class") -> DataFrame:
    """Low, Moderate or High by two quantiles of the whole column."""
    stats = rows.agg(quantile(value, cuts[0]).alias("_a"), quantile(value, cuts[1]).alias("_b"))
    out = rows.crossJoin(F.broadcast(stats))  # one row of quantiles
    x = F.col(value)
    return out.select(*rows.columns, F.when(x <= F.col("_a"), "Low").when(x <= F.col("_b"), "Moderate").when(x.isNotNull(), "High").alias(name))


def uncorrelated(rows: DataFrame, columns: list[str], threshold: float = 0.7, least_valid: float = 0.8) -> list[str]:
    """Columns without "_cl_" in their name that are mostly neither null nor zero, less each that
    correlates beyond the threshold with one before it. Only the matrix of correlations is collected."""
    names = [c for c in columns if "_cl_" not in c]
    shares = rows.agg(*(F.avg(((F.col(c) != 0) & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in names)).first()
    names = [c for c in names if (shares[c] or 0) >= least_valid]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return names
    from freshet.functions.expr import pearson

    found = rows.agg(*(F.abs(pearson(a, b)).alias(f"{a}|{b}") for a, b in pairs)).first()
    return [b for b in names if not any((found[f"{a}|{b}"] or 0) > threshold for a in names[: names.index(b)])]


def interpolated(rows: DataFrame, value: str) -> DataFrame:
    """Nulls between known values filled along the straight line through the days; ends stay null."""
    w = by(KEY, TIME)
    known = F.when(F.col(value).isNotNull(), F.struct(TIME, value))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = rows.withColumn("_b", before).withColumn("_a", after)
    share = div(F.datediff(TIME, F.col(f"_b.{TIME}")), F.datediff(F.col(f"_a.{TIME}"), F.col(f"_b.{TIME}")))
    line = F.col(f"_b.{value}") + share * (F.col(f"_a.{value}") - F.col(f"_b.{value}"))
    return out.select(*(F.coalesce(value, line).alias(value) if c == value else F.col(c) for c in rows.columns))


def densified(rows: DataFrame) -> DataFrame:
    """One row for every day between each key's first and last, nulls where there was none."""
    spans = rows.groupBy(KEY).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b"))
    days = spans.select(KEY, F.explode(F.sequence("_a", "_b")).alias(TIME))
    return days.join(rows, [KEY, TIME], "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], wins: str = "new") -> DataFrame:
    """Full outer join by keys; of two present values the new one wins, or the old with wins="old"."""
    names = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in names))
    b = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in names))
    order = ("_new_", "_old_") if wins == "new" else ("_old_", "_new_")
    return a.join(b, keys, "full_outer").select(*keys, *(F.coalesce(*(p + c for p in order)).alias(c) for c in names))


def overwritten(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with columns taken from new wherever the keys meet, nulls included, and new's other rows added."""
    b = new.select(*keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    rows = old.join(b, keys, "full_outer")
    return rows.select(*keys, *(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns if c not in keys))


def with_dataset(rows: DataFrame, datasets: list[str], prefix: str = "prcp_") -> DataFrame:
    """One row per dataset, its forcing in one column named like the prefix without its underscore."""
    value = prefix.rstrip("_")
    names = [prefix + d for d in datasets]
    rest = [c for c in rows.columns if c not in names]
    long = rows.unpivot(rest, names, "_name", value)
    return long.select(*rest, F.substring("_name", len(prefix) + 1, 64).alias("dataset"), value)


def leave_one_out(gauges: DataFrame) -> DataFrame:
    """(fold, gauge_id): every fold's training gauges, all but its own. One row of a pair per gauge and
    fold, the size of a table of folds."""
    a = gauges.select(F.col(KEY).alias("fold"))
    return a.join(gauges.select(KEY), F.col("fold") != F.col(KEY))


def nearest_cell(points: DataFrame, step: float, lon0: float = 0.0, lat0: float = 0.0) -> DataFrame:
    """Points with the indexes of the regular grid cell whose centre is nearest."""
    near = lambda x, x0: F.floor((F.col(x) - x0) / step + 0.5).cast("long")
    return points.select("*", near("lon", lon0).alias("cell_x"), near("lat", lat0).alias("cell_y"))


def nearest_vote(known: DataFrame, asked: DataFrame, k: int = 5, block: int = 100_000) -> DataFrame:
    """(id, label): most frequent label (the smallest of equals) among the k known points (id, x, y,
    label) nearest to each asked point (id, x, y). The known points go to every task in blocks of about
    `block` rows; each block leaves its k nearest, and these meet."""
    a = asked.select("id", "x", "y")
    others = known.select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), "label")
    far = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    blocks = max(1, -(-known.count() // block))

    def nearest(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("id").orderBy("_far", "_id"))
        return rows.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")

    parts = []
    for i in range(blocks):
        own = others.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == i) if blocks > 1 else others
        parts.append(nearest(a.join(F.broadcast(own), F.col("id") != F.col("_id")).select("id", "_id", "label", far.alias("_far"))))
    best = parts[0] if blocks == 1 else nearest(reduce(DataFrame.union, parts))
    return best.groupBy("id").agg(F.mode("label", True).alias("label"))


def z_scores(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns as standard scores (sample deviation) over each group, or over all rows: their mean and
    deviation are one row then, which every task gets."""
    stats = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    if keys:
        known = rows.groupBy(*keys).agg(*stats)
        same = rows.alias("_r").join(known.alias("_k"), [F.col(f"_r.{k}").eqNullSafe(F.col(f"_k.{k}")) for k in keys])
    else:
        one = rows.agg(*stats).select(F.lit(1).alias("_one"), "*")
        same = rows.alias("_r").withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    own = {c: F.col(f"_r.{c}") if keys else F.col(c) for c in rows.columns}
    return same.select(*((div(x - F.col(f"_m_{c}"), F.col(f"_s_{c}")) if c in columns else x).alias(c) for c, x in own.items()))


def argmax_column(rows: DataFrame, columns: list[str], name: str = "best") -> DataFrame:
    """rows with the name of the column that has the largest value; the first of equals."""
    values = F.array(*(F.col(c).cast("double") for c in columns))
    return rows.withColumn(name, F.get(F.array(*map(F.lit, columns)), (F.array_position(values, F.array_max(values)) - 1).cast("int")))


def seasonal_cycle(series: DataFrame, value: str = "q", how: str = "median") -> DataFrame:
    """(gauge_id, month, day, q): median or mean over the years of every day of the year."""
    step = {"median": F.median, "mean": F.avg}[how]
    return series.groupBy(KEY, F.month(TIME).alias("month"), F.dayofmonth(TIME).alias("day")).agg(step(value).alias(value))


def resampled(rows: DataFrame, days: int, value: str = "q", how: str = "mean") -> DataFrame:
    """Sums, means, minima or maxima of spans of so many days from each key's first day."""
    step = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how]
    first = F.min(TIME).over(Window.partitionBy(KEY))
    start = F.date_add(first, (F.floor(F.datediff(TIME, first) / days) * days).cast("int"))
    return rows.select(KEY, start.alias(TIME), value).groupBy(KEY, TIME).agg(step(value).alias(value))


def completeness(rows: DataFrame, value: str = "q") -> DataFrame:
    """(gauge_id, class): full, partial or empty by the share of null values."""
    share = F.count(value) / F.count("*")
    return rows.groupBy(KEY).agg(share.alias("valid_share"), F.when(share == 1, "full").when(share > 0, "partial").otherwise("empty").alias("class"))


def split_basins(gauges: DataFrame, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """gauges with split: train, validation or test, by a hash of the id, the same on every run."""
    x = F.pmod(F.xxhash64(F.col(KEY), F.lit(seed)), F.lit(10_000)) / 10_000
    return gauges.withColumn("split", F.when(x < shares[0], "train").when(x < sum(shares), "validation").otherwise("test"))
