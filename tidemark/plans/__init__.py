"""Pipelines composed of operators, and a command line."""
