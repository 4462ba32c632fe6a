"""Lumigraph: Spark-native analytics over web image corpora and classifier scores."""
