"""Evidence search and training-data preparation on Spark."""
