"""Spark-native analytics for mitochondrial sequencing cohorts."""
