"""quire: a PySpark-native engine for structured documents and corpus-scale text."""
