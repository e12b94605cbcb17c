"""siltstone: a Spark-first context index, retrieval and corpus engine."""

__version__ = "0.1.0"
