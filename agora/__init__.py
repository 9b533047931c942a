"""Spark-native engine for collecting, enriching and analysing short-form political discourse."""
