"""quillspark: full-text search and document analytics on Spark DataFrames."""
