"""A Spark-native engine for versioned JSON records and the documents they come from."""
