"""Self-organizing maps and training-data operators on PySpark DataFrames."""
