"""strandwise: a Spark-native analytics engine for evidence catalogues."""

__version__ = "0.1.0"
