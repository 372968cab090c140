"""Operators of a training-data pipeline: filters, near-duplicates, redaction and packing over a documents table."""
