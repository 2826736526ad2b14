"""A PySpark-native analytics engine for semi-structured listing records."""
