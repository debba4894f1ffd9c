"""A Spark-native fact reconciliation engine: documents -> grounded facts -> candidate pairs -> verdicts."""
