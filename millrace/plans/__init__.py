"""Packaged queries: each a function from a session and a folder of tables to a DataFrame, with DuckDB SQL beside it."""

from millrace.plans import hits_queries, op_queries, problems

#: Modules with QUERIES and SQL, by query name.
REGISTRIES = (hits_queries, op_queries, problems)
