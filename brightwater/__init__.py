"""Spark table and stream operators for the data that AI applications produce and consume."""
