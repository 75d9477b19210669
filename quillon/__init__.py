"""quillon: a Spark-native engine for annotated document stores and their metrics."""
