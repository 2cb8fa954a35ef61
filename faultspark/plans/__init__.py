"""Whole workloads, and the registered queries with their SQL."""
