"""All queries of the library, and their SQL."""

from corvex.plans import backlog_queries, corpus_queries, document_queries, hybrid_queries, registry_queries, rule_queries, stage_queries, store_queries, text_queries, workspace_queries

MODULES = (text_queries, corpus_queries, document_queries, hybrid_queries, registry_queries, stage_queries, rule_queries, store_queries, backlog_queries, workspace_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
