"""A Spark-native engine for hierarchical name catalogues."""
