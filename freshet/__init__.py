"""Analytics of daily environmental time series on Spark: signatures, skill, statistics, models."""
