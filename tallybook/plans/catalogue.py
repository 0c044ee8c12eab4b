"""All registered queries and their oracles."""

from __future__ import annotations

from tallybook.plans import layouts, parsing, sales, segments

MODULES = [sales, layouts, parsing, segments]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
