"""Spark-native analytics for networks of fixed land cameras and the terrain they watch."""
