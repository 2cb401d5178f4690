"""Every operator as a query on the given tables, and the same in plain SQL."""
