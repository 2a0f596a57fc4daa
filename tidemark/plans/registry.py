"""All queries of the library, apart from those for training text."""

from __future__ import annotations

from tidemark.plans import panel_queries, reconcile_queries, run_queries, table_queries

QUERIES = {**panel_queries.QUERIES, **reconcile_queries.QUERIES, **run_queries.QUERIES, **table_queries.QUERIES}
SQL = {**panel_queries.SQL, **reconcile_queries.SQL, **run_queries.SQL, **table_queries.SQL}
