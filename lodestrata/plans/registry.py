"""Every registered query of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

from lodestrata.plans import code, given, relations, retrieval, segmented

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (retrieval, relations, code, segmented, given):
    QUERIES |= _part.OWN.queries
    ORACLES |= _part.OWN.oracles
