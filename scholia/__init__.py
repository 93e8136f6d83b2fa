"""A Spark-native engine for academic records, and operators for training data (in llm)."""
