"""Table profiling, document preparation and reports on PySpark."""
