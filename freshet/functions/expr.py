"""Column expressions with one meaning for nulls, zeros and constants.

Missing values are null. A quotient by zero, a logarithm of what is not positive and a correlation
with a constant are null, never an error, a NaN or an infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def over_positive(a: Column | str, b: Column | str) -> Column:
    """a / b where b is positive, else null."""
    return F.when(col(b) > 0, div(a, b))


def ln(x: Column | str) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def quantile(x: Column | str, p: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(col(x), F.lit(float(p)))


def cv(x: Column | str) -> Column:
    """Population standard deviation over mean."""
    return div(F.stddev_pop(col(x)), F.avg(col(x)))


def sample_skew(x: Column | str) -> Column:
    """Skewness with the sample correction; null for fewer than 3 values or a constant."""
    n = F.count(col(x)).cast("double")
    return F.when((n > 2) & (F.var_pop(col(x)) > 0), F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column | str) -> Column:
    """Excess kurtosis with the sample correction; null for fewer than 4 values or a constant."""
    n = F.count(col(x)).cast("double")
    corrected = ((n + 1) * F.kurtosis(col(x)) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when((n > 3) & (F.var_pop(col(x)) > 0), corrected)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation over the rows where both are present; null where one is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def clean(x: Column | str, sentinels: tuple[float, ...] = (-9999.0, -999.0)) -> Column:
    """NaN and the sentinels for missing values become null."""
    value = col(x).cast("double")
    return F.when(~F.isnan(value) & ~value.isin(*sentinels), value)


def hydro_year(date: Column | str, start_month: int = 10) -> Column:
    """The year in which the hydrological year that began in start_month ends."""
    return F.year(col(date)) + (F.month(col(date)) >= start_month).cast("int")


def season(date: Column | str) -> Column:
    month = F.month(col(date))
    return (
        F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer").otherwise("autumn")
    )


def hydro_day(date: Column | str) -> Column:
    """Day of the hydrological year from October: day 1 is 1 October of a common year."""
    return F.when(F.month(col(date)) >= 10, F.dayofyear(col(date)) - 273).otherwise(F.dayofyear(col(date)) + 92)


def normalized(df: DataFrame, key: str = "gauge_id", time: str = "date", value: str = "q") -> DataFrame:
    """(key string, date, value double): missing values null, one row for each key and day (the mean
    of those present). All operators take this form."""
    rows = df.select(F.col(key).cast("string").alias(key), F.to_date(time).alias(time), clean(value).alias(value))
    return rows.where(f"{key} is not null and {time} is not null").groupBy(key, time).agg(F.avg(value).alias(value))


def by(key: str, time: str):
    return Window.partitionBy(key).orderBy(time)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero, so that results of different summation orders agree;
    dates as text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f.name).cast("double")
            out.append((F.round(F.when(~F.isnan(x), x), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.col(f.name).cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
