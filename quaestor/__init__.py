"""Question/answer retrieval as Spark jobs: DataFrame in, DataFrame out."""
