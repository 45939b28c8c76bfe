"""All registered queries of the library, without those of the removable corpus operators."""

from __future__ import annotations

from engramix.plans import analytics, extras, flows, retrieval  # noqa: F401  (they register their queries)
from engramix.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
