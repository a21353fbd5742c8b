"""A PySpark-native engine for engineering-drawing data and large text corpora."""
