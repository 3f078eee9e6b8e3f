"""PySpark-native engine for batch model-inference workloads and training-data preparation."""
