"""Reading and writing post tables, signal tables and stored pages."""
