"""A Spark-native engine that counts what a warehouse's data and queries actually are."""
