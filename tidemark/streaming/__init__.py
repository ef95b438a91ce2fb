"""Incremental features as stateful streams, and windowed aggregates with watermarks."""
