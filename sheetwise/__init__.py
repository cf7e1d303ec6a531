"""Question analytics over tables, as Spark DataFrame operations."""
