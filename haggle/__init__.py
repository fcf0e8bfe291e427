"""Spark-native collection, normalisation and serving of marketplace deal posts."""
