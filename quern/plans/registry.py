"""All queries of the engine itself."""

from __future__ import annotations

from quern.plans import code, corpus, generic, ledger, patch, retrieval, sketches, state, streams

MODULES = (retrieval, ledger, corpus, state, patch, code, generic, streams, sketches)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
