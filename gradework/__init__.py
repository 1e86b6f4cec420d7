"""gradework: a Spark-native engine for image-derived screening analytics."""
