"""Relational operators that tracking data needs and Spark lacks by name, as compositions of DataFrame operations."""
