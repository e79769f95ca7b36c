"""Star-schema analytics on PySpark."""
