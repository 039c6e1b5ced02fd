"""Table preparation, ordered features, ratings, evaluation and image prep on Spark."""
