"""A PySpark-native analytics engine for version-controlled history."""
