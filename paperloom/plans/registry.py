"""Every query of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from paperloom.plans import (
    catalog_queries,
    desk_queries,
    document_queries,
    event_queries,
    intake_queries,
    review_queries,
    similarity_queries,
    structure_queries,
)

_ALL = (review_queries, document_queries, similarity_queries, catalog_queries, desk_queries, intake_queries, event_queries, structure_queries)

QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _ALL for name, sql in m.ORACLES.items()}
