"""paperloom: Spark-first analytics, ranked retrieval and text preparation for document collections."""

__version__ = "0.1.0"
