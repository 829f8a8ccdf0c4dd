"""Operators: functions of DataFrames to a DataFrame. None collects rows or loops over them on the driver."""
