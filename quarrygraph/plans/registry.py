"""All queries and oracles of the engine's own operators."""

from . import catalog, catalog_code, catalog_more, catalog_reports, catalog_upkeep  # noqa: F401  (each adds its queries)

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
