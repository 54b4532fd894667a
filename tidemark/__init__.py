"""Tidemark: a PySpark library for listings, ranked search and corpus preparation."""
