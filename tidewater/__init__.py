"""Spark-native analytics for streams of documents, events, prices and entity graphs."""
