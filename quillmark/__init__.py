"""Quillmark: document-evaluation analytics and training-data operators on Spark DataFrames."""
