"""lumbre: a PySpark-native engine for filing and insider-transaction analytics."""
