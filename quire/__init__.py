"""Document-corpus processing on PySpark."""
