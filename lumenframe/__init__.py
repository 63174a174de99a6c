"""Lumenframe: detection-and-embedding analytics as Spark DataFrame plans."""
