"""Hand-checked series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.functions.expr import normalized
from freshet.operators import signatures as s


def series(spark, values, start=dt.date(2020, 1, 1), gauge="g"):
    rows = [(gauge, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "gauge_id string, date date, q double")


def test_tiny_series(spark):
    r = s.duration_metrics(series(spark, [1, 2, 2.5, 7, 9, 30, 4.0])).first()
    assert (r.q95, r.median_flow) == (pytest.approx(1.3), 4)
    assert r.skewness == pytest.approx(2.234363285) and r.kurtosis == pytest.approx(5.270480665)
    assert s.basic_statistics(series(spark, [1, 2, 2.5, 7, 9, 30, 4.0])).first()["std"] == pytest.approx(9.390072917)


def test_event_ends_at_the_first_row_after_it(spark):
    rows = series(spark, [0.0, 1, 1, 0, 0, 1])
    got = sorted((str(r.start), r.duration) for r in s.events(rows, F.col("q") > 0).collect())
    assert got == [("2020-01-02", 3), ("2020-01-06", 1)]


def test_nulls_and_constants(spark):
    flat = series(spark, [5.0] * 40)
    assert s.autocorrelation(flat).first().lag1_autocorr == 0
    assert s.variability_metrics(flat).first().cv == 0
    assert s.basic_statistics(series(spark, [None, None])).count() == 0
    one = s.temporal_variability(series(spark, [3.0])).first()
    assert one.daily_change_mean is None and one.weekly_cv is None
    zero = s.flashiness(series(spark, [0.0, 0.0])).first()
    assert zero.flashiness_index is None


def test_percentile_range():
    with pytest.raises(ValueError):
        s.exceedance(101)


def test_normalized(spark):
    rows = spark.createDataFrame(
        [("a", "2020-01-01", 1.0), ("a", "2020-01-01", 3.0), ("a", "2020-01-02", -9999.0), ("a", "2020-01-03", float("nan")), (None, "2020-01-01", 1.0)],
        "gauge_id string, date string, q double",
    )
    assert [(str(r.date), r.q) for r in normalized(rows).orderBy("date").collect()] == [("2020-01-01", 2.0), ("2020-01-02", None), ("2020-01-03", None)]


def test_period_needs_enough_rows(spark):
    rows = series(spark, [1.0, None, None, None])
    assert s.period_metrics(rows).first().mean_discharge is None
    with pytest.raises(ValueError):
        s.aggregated_periods(s.period_metrics(rows), "mode")


def test_year_limits_differ(spark):
    """A year of exactly 300 rows counts for the timing of extremes but not for annual maxima."""
    rows = series(spark, [float(i) for i in range(300)])
    assert s.annual_maxima(rows).count() == 0
    assert s.extreme_timing(rows).first().max_timing_mean == 300
    assert s.timing_indices(rows).first().ta01 is None
