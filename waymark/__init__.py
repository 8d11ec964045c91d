"""waymark: place-retrieval analytics on PySpark DataFrames."""
