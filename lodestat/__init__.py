"""Lodestat: a Spark-native engine for validating scored accounts (default and loss models)."""
