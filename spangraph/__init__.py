"""spangraph: a PySpark-native analytics engine for walks through sequence graphs."""
