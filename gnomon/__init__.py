"""gnomon: a PySpark-native knowledge-analytics engine."""
