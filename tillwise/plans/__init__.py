"""Derived tables and the query catalogue built on them."""
