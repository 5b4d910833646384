"""A PySpark-native decision-analytics engine."""
