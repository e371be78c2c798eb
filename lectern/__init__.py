"""Document question-answering analytics on Spark DataFrames."""
