"""Register analytics on Spark: longitudinal person records, families, chronic disease, income and matching.

Every operator takes DataFrames (or Columns) plus options and returns a DataFrame (or Column).
"""
