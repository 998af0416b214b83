"""loamdex: incremental document indexing and hybrid retrieval on Spark DataFrames."""
