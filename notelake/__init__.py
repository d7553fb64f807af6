"""Notelake: note analytics, retrieval and corpus preparation on PySpark."""
