"""The queries of this package and their SQL."""

from __future__ import annotations

from . import decontaminate, html, licenses, neardup, packing, pii, quality, sharding, urlfilter, warc

MODULES = (warc, pii, quality, urlfilter, licenses, neardup, decontaminate, packing, html, sharding)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
