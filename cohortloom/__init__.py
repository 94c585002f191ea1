"""Cohort, panel and forecast analytics on Spark DataFrames.

Operators take column names and return DataFrames, so they run on any table with
entities, cohorts, periods and values.
"""
