"""A Spark-native engine for preparing and searching large text corpora."""
