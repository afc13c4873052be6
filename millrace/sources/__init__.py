"""Reading and writing tables: delimited text with explicit schemas, and columnar files."""
