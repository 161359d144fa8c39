"""Reading and writing base tables, payloads and reference data."""
