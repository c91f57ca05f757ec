"""sparkcorpus: a PySpark-native engine for text corpora, retrieval and evaluation."""

__version__ = "0.1.0"
