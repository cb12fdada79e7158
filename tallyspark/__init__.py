"""Spark-native operators for messy financial, assessment and text tables."""
