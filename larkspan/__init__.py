"""larkspan: a Spark-first analytics engine for personal search corpora."""

__version__ = "0.1.0"
