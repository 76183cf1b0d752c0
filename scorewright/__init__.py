"""Text scoring and training-data preparation as Spark DataFrame operators."""
