"""Spark-native usage-log analytics: DataFrame operators, table jobs and streams."""
