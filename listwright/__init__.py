"""Listings analytics on Spark: operators are DataFrame -> DataFrame functions with column names as parameters."""
