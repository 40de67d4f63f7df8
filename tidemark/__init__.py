"""A PySpark engine for market time series and training-data tables."""
