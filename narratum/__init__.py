"""narratum: Spark-native processing of book-like text collections."""
