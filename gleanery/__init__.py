"""Spark-native retrieval analytics over ordinary DataFrames."""
