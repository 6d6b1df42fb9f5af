"""A Spark-native document memory: search, lifecycle, evidence and training-data operators."""
