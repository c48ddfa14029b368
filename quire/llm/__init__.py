"""Operators for preparing training data: extraction, tokenising, scoring,
deduplication, secret scans, packing and binary output.

Nothing outside this subpackage imports it.
"""
