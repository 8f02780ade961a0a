"""Spark-native dataset curation and extraction evaluation."""
