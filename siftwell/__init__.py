"""Siftwell: retrieval and corpus analytics as lazily evaluated Spark plans."""
