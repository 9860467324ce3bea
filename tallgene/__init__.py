"""Spark-native analytics for long sparse cell x gene tables, sequences, predictions and embeddings."""
