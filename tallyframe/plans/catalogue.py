"""All queries of the library."""

from tallyframe.plans import aggregates, arrivals, columns, extract, faces, forms, pages, quality, sets, sources, spatial, support  # noqa: F401  # each module registers its own
from tallyframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
