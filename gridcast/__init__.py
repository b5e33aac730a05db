"""A PySpark-native analytics engine for renewable-generation time series."""
