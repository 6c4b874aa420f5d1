"""kinweave: graph clustering of embedding vectors and corpus operators on Spark DataFrames."""
