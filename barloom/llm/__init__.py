"""Operators for preparing training data: packing, scoring, scans, extraction, deduplication, filters."""
