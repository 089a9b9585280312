"""A PySpark-native engine that finds, ranks, aligns and scores moments in collections of timestamped media records."""
