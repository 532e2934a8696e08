"""Paired-ranking, resampling, selection and audit operators on Spark DataFrames."""
