"""All queries of the core: name -> plan, and name -> DuckDB statement."""

from __future__ import annotations

from quire.plans import formats, ingest, lookups, passages, quality, reading, records, search, streams

MODULES = (search, passages, records, ingest, formats, quality, reading, lookups, streams)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
