"""Imports every module that registers queries."""

from __future__ import annotations

from . import entity_queries, history_queries, listing_queries, monitor_queries, review_queries, source_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
