"""Composite queries: dashboard, reports, search."""
