"""docweave: document-corpus analytics on Spark DataFrames."""
