"""A PySpark-native engine for retrieval-augmented-generation experiments."""
