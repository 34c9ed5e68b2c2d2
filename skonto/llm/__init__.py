"""Operators for preparing training corpora: filters, near-duplicate joins, packing, archives and search."""
