"""quillspark: knowledge retrieval and corpus analytics as Spark DataFrames."""
