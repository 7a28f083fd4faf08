"""Operators for preparing training data: filtering, deduplication, scoring, mixing and packing."""
