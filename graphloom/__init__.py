"""Interaction tables in, user and item graphs out, as lazy Spark DataFrames."""
