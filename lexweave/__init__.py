"""Spark-native text segmentation and tagging."""
