"""Spark-native analytics: telemetry integrity operators, and (in `llm`, on its own) training-data operators."""
