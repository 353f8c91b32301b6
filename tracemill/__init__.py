"""Spark-native analytics over agent and LLM gateway traces."""
