"""Clinic operators: functions from DataFrames to DataFrames."""
