"""All query keys: importing the plan modules registers them."""

from __future__ import annotations

from .plans import aggregates, exact, filters, formulas, joins, layout, locate, retrieval, review, sections, sources, streams, texts, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
