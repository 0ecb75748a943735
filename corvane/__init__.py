"""corvane: a PySpark-native retrieval and corpus-processing engine."""

__version__ = "0.1.0"
