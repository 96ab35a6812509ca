"""scholia: a PySpark-native analytics engine for study records and document corpora."""
