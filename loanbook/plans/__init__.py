"""Whole jobs: load a tape directory, run a query, train and score models."""
