"""corvane: a Spark-native engine for document corpora, retrieval experiments and their evaluation."""

__version__ = "0.1.0"
