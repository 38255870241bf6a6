"""Siltstone: web-corpus analytics as PySpark DataFrame operators."""
