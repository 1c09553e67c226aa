"""A Spark-native engine for security-alert triage."""
