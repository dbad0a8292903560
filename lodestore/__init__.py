"""A PySpark-native vector memory and similarity-search engine."""
