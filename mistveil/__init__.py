"""PySpark-native PII detection, reversible masking and text processing."""
