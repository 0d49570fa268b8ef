"""Registered queries: each reads the shared tables and grows with them."""

from . import annotation, curation, records, selection, splits

QUERIES = {}
ORACLES = {}
for _module in (curation, splits, annotation, records, selection):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
