"""Spark-native analytics over segmented-media manifests."""
