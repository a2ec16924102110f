"""Emberline: a Spark-native engine for catalogues of events with attached evidence."""
