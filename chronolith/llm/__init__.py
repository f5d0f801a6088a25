"""Training-data operators: packing, search, quality, counts, dedup, HTML, mixing, PII, token files.

Nothing else in the library imports this subpackage. ``queries`` and ``oracle_sql`` of
``chronolith.llm.registry`` hold the registered queries.
"""
