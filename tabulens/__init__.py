"""Tabular analysis on Spark: profiling, quality audit, cleaning, statistics, correlation,
outliers, ad-hoc aggregates and chart-ready data as functions from DataFrame to DataFrame."""
