"""Spark-native spatiotemporal risk analytics: operators are functions from DataFrames to DataFrames."""
