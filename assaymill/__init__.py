"""Screening, evidence scoring and cohort analytics over Spark DataFrames."""
