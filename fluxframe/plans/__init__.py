"""Views over the given tables, the registered queries and the multi-step chains."""

from fluxframe.plans import columns, fits, grids, layers, scores, spectra, tables  # noqa: F401  (registers queries)
from fluxframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
