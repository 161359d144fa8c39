"""The chain of tables, the reports on it, and how both are published."""
