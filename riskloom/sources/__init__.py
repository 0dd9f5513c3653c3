"""Readers: event chunks, single tables, link CSV files, call-file listings, source checks."""
