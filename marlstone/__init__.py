"""Marlstone: a PySpark-native relational and similarity-search engine."""
