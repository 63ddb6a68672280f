"""Operators: DataFrame to DataFrame, statistics as DataFrames of their own."""
