"""Loomstone: a Spark-native engine for code, document and event intelligence."""
