"""corpusmill: a PySpark-native analytics engine for dialogue and text corpora."""
