"""Spark-native token scoring and extractive text compression."""
