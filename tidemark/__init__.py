"""Tidemark: ordered collections, log-structured stores and positional sequences as PySpark DataFrame operators."""
