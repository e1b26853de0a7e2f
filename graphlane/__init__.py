"""graphlane: a PySpark-native engine for large directed graphs."""
