"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()`` hand
the driver one query per operator plus the whole pipeline.
"""

from tarmac.llm.entry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
