"""All registered queries outside the training-data operators."""

from tillage.plans import chunk_queries, entity_queries, store_queries, text_queries

QUERIES = {**entity_queries.QUERIES, **chunk_queries.QUERIES, **text_queries.QUERIES, **store_queries.QUERIES}
ORACLE_SQL = {**entity_queries.SQL, **chunk_queries.SQL, **text_queries.SQL, **store_queries.SQL}
