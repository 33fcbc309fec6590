"""PySpark analytics over linked text corpora: cleaning, topics, interactions, statistics."""

__version__ = "0.1.0"
