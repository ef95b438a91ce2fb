"""Column functions: windows, null-safe arithmetic, statistics."""
