"""All core queries and their SQL."""

from __future__ import annotations

from lociforge.plans import file_queries, problems, typing_queries

QUERIES = {**typing_queries.QUERIES, **file_queries.QUERIES, **problems.QUERIES}
ORACLE = {**typing_queries.ORACLE, **file_queries.ORACLE, **problems.ORACLE}
FLAGSHIP = typing_queries.wibs_pairs
