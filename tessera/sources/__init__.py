"""Readers and writers of projects, fact tables, clusterings and graphs."""
