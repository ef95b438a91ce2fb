"""Readers, writers and storage strategies."""
