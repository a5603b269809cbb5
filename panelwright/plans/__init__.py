"""Whole jobs and the adapters that derive market-like tables."""
