"""Spark-native document retrieval, citation and corpus-preparation operators."""

__version__ = "0.1.0"
