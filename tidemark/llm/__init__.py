"""Operators for preparing large text corpora: search, deduplication, formatting, output, mixing, cleaning."""
