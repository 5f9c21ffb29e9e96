"""tidelog: Spark-native analytics for timestamped, multi-topic message recordings."""
