"""A Spark-native engine for code and document intelligence."""
