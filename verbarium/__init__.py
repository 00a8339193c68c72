"""Verbarium: a PySpark-native lexical search and corpus analytics engine."""
