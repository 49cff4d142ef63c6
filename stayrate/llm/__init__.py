"""Operators for preparing training text: scans, filters, deduplication, mixing, packing, search."""
