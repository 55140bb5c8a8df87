"""Prepare, classify and evaluate labelled text with Spark DataFrames."""
