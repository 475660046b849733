"""maskwright: a Spark-native engine for finding and treating re-identification risk in wide tables."""
