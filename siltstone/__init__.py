"""A Spark-native store and query engine for versioned records with vectors."""
