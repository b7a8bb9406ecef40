"""Tessera: document retrieval, evaluation and corpus maintenance as lazy Spark DataFrame plans."""
