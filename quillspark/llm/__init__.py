"""Operators for large-scale training-data pipelines.

Every module here is self-contained apart from ``common``; nothing outside this
subpackage imports it.  ``queries.queries()`` and ``queries.oracle_sql()`` list
the registered queries.
"""
