"""All queries of the library and their SQL counterparts, by name."""

from __future__ import annotations

from fieldsense.plans import content, data, evaluation, training, windows  # noqa: F401  registers them
from fieldsense.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
