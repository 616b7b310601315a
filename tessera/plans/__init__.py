"""Iterative plans and the query catalogue."""
