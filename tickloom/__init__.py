"""A Spark-native engine for timed record streams."""
