"""All registered queries and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from docketlens.plans import (
    catalog_browsing,
    catalog_finder,
    claim_ledger,
    docket_merging,
    docket_survival,
    finder_matching,
    incremental,
    page_listings,
    published,
    source_lifecycle,
    text_classifiers,
)

_MODULES = [docket_survival, docket_merging, source_lifecycle, page_listings, text_classifiers, finder_matching, catalog_browsing, catalog_finder, claim_ledger, incremental, published]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
