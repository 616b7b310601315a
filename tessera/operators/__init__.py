"""Operators on graphs of named entities."""
