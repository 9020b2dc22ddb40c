"""Transaction sequence analytics on Spark: cleaning, splits, tokens, sequences, features and metrics."""
