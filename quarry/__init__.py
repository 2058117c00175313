"""quarry: a PySpark-native analytics engine for document, code-graph and change-history corpora."""
