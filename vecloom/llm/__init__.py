"""Operators for preparing training data: scoring, filtering, deduplication, mixing, packing and export."""
