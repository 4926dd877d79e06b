"""Spark-native retrieval and curation engine for durable lesson memory."""

__version__ = "0.1.0"
