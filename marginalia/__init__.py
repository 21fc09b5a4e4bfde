"""Spark-native text corpus engine: load, clean, chunk, index, search, describe, extract."""
