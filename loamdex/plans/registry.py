"""Every query of the document engine, with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import search_queries, store_queries  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
