"""Pattern-matching analytics on PySpark."""
