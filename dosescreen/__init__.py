"""Dose-response screening and evidence integration on Spark DataFrames."""
