"""Relational, time-series, spatial and physical operators: functions from DataFrames to DataFrames."""
