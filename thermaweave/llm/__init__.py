"""Operators for preparing training data: scans, classifiers, deduplication, packing, formatting, scoring."""
