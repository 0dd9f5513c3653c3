"""Operators for large-scale training-data pipelines, their registered queries and SQL.

Nothing outside this subpackage imports it, ``__spark_entry__.py`` aside.
"""
