"""A Spark-native analytics and context-retrieval engine."""
