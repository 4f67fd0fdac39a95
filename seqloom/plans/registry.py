"""All queries outside of the training-data subpackage, by name."""

from __future__ import annotations

from seqloom.plans import exchange_queries, general, graph_queries, sequence_queries

FLAGSHIP = "recommend_single_source"
QUERIES = {**sequence_queries.QUERIES, **graph_queries.QUERIES, **general.QUERIES, **exchange_queries.QUERIES}
SQL = {**sequence_queries.SQL, **graph_queries.SQL, **general.SQL, **exchange_queries.SQL}
