"""corpusloom: a PySpark-native engine for preparing, indexing and querying text and code corpora."""
