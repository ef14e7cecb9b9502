"""corpusloom: a PySpark-native retrieval and analytics engine for research corpora."""

__version__ = "0.1.0"
