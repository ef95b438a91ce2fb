"""Operators over panel DataFrames."""
