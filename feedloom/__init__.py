"""feedloom: a PySpark-native engine for listing feeds."""
