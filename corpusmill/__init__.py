"""corpusmill: text and source-corpus quality analytics on Spark DataFrames."""
