"""leafline: a Spark-native engine that treats documents as relations of blocks."""
