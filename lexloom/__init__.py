"""lexloom: a PySpark-native engine for the data side of language-model engineering."""
