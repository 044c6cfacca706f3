"""The library's registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from quillstone.catalog import graphs, operations, platform, records, retrieval

_PARTS = (records.R, retrieval.R, graphs.R, operations.R, platform.R)
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.sql.items()}
FLAGSHIP = "lexical_bm25"
