"""tidemark: code-review analytics and training-data operators, written for Spark."""
