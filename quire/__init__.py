"""Spark-native engine that turns scanned, paged documents into a queryable library."""
