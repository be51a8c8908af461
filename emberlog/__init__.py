"""A Spark-native engine for investigating log data."""
