"""All queries of the library and the SQL that each is held against."""

from __future__ import annotations

from . import bodies, catalogue, containers, ingest, intervals, match, more, node, scalar, streams

MODULES = (match, intervals, catalogue, ingest, scalar, streams, more, node, containers, bodies)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
