"""quern: a Spark-native engine for keyed knowledge records, ledgers and text corpora."""
