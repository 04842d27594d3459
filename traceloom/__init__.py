"""Spark-native timeline analytics: filters, search, temporal statistics and rule-based detection as DataFrame plans."""
