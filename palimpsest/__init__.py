"""PySpark-native engine for versioned symbol snapshots and the question-answer data derived from them."""
