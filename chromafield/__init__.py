"""Multi-sensor signal analytics as PySpark DataFrame functions.

Every operator takes DataFrames or Columns and returns lazy DataFrames or
Columns, so Catalyst sees the whole plan.  See ``COVERAGE.md`` for the list.
"""

from chromafield.session import configure, get_session

__all__ = ["configure", "get_session"]
