"""A PySpark-native engine for security-telemetry analytics."""
