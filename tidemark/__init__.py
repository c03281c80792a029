"""Spark-native evidence analytics: every operator is a DataFrame-to-DataFrame function."""
