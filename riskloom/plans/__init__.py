"""Derived fixture tables and the query catalogue."""
