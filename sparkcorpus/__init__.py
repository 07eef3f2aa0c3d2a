"""sparkcorpus: a Spark-native engine for corpus retrieval, synchronisation and preparation."""

__version__ = "0.1.0"
