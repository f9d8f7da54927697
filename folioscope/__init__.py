"""Spark-native search, topic analytics and training-data operators."""
