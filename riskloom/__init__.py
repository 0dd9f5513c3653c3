"""riskloom: risk and fraud feature work as lazy Spark DataFrame plans.

Sub-packages:
  sources    readers for event chunks, application/label tables, link CSV, call listings
  functions  column-expression builders (call names, keys, bands, text, statistics)
  operators  DataFrame -> DataFrame operators (features, joins, cleaning, metrics, reports)
  plans      derived fixture tables and the query catalogue used by the entry module
  streaming  the event feature aggregates over a file stream
"""

from riskloom.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
