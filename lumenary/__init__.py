"""Media-library analytics on PySpark."""
