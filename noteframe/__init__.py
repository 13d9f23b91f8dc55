"""Spark-native operators for scoring, text-marker extraction and evaluation tables."""
