"""Readers of rupture and grid files, writers of results, and adapters for the test tables."""
