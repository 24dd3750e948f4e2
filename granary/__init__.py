"""Granary: a PySpark-native analytics engine for lending risk and corpus preparation."""
