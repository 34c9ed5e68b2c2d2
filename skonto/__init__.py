"""Payables and dunning analytics as Spark DataFrame functions."""
