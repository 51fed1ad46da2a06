"""Named queries of the library; importing this package registers all of them."""

from granary.plans import chunk_queries, model_queries, office_queries, remote_queries, retrieval_queries, search_queries, session_queries, source_queries, state_queries, sweep_queries, table_queries, text_queries, value_queries
from granary.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "chunk_queries", "model_queries", "office_queries", "remote_queries", "retrieval_queries", "search_queries", "session_queries", "source_queries", "state_queries", "sweep_queries", "table_queries", "text_queries", "value_queries"]
