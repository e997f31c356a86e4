"""Training-data operators: scans, filters, deduplication, packing, tokenizing, scoring.

Nothing else in the library imports this subpackage.
"""
