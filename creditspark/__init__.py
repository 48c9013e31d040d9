"""Spark-native lending analytics: features, tests, preparation, models, scoring."""
