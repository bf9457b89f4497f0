"""Spark-native operators for interval-, position- and text-shaped data."""
