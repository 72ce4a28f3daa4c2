"""A Spark-native engine for code-review workloads."""
