"""A Spark-native engine for file and document inventories."""
