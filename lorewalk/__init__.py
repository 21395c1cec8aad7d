"""Code-fact analytics on Spark: facts are DataFrames, questions are declarative plans."""
