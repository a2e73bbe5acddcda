"""lexigrid: a Spark-native engine for word-level annotated text corpora."""
