"""Operators of a training-data pipeline: deduplication, decontamination, scans, search, archives and packing."""
