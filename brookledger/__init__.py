"""brookledger: a PySpark-native analytics engine for personal-finance ledgers."""
