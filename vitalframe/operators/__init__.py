"""Operators: functions from DataFrames to DataFrames. Imported by module."""
